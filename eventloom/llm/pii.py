"""Personal data with offset-preserving deobfuscation.

Plain identifiers are found in the text as it stands. Every text also goes through a transducer, which rewrites
homoglyphs and invisible characters, spelled-out digits and at/dot disguises and keeps, for every piece it writes, the
source characters that it stands for. The same detectors run over a text that was rewritten; a find that holds a
rewritten piece is mapped back to its source characters and added unless it overlaps a plain find of its kind.

A name at a host, as in "mail ann at example.com", is read as an address only where a word for mail stands one or two
words before the name, or the name has a sign or digit inside: "look at example.com" is not one.

Offsets are code points, ends exclusive. Texts are scanned whole, each in time linear in its length: the rules begin at a
sign or word, never at the blanks before it, which are read backwards once. The operator is a narrow stage. Defined results: null and empty texts have no spans; repeated rows are scanned alike; extra columns are
ignored.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match never begins after a digit, as the one before would have taken that digit
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

#: Digits as words in English, French, German and Spanish.
DIGIT_WORDS = {
    "0": "zero oh nought zéro null cero",
    "1": "one un une eins ein uno una",
    "2": "two deux zwei zwo dos",
    "3": "three trois drei tres",
    "4": "four quatre vier cuatro",
    "5": "five cinq fünf cinco",
    "6": "six sechs seis",
    "7": "seven sept sieben siete",
    "8": "eight huit acht ocho",
    "9": "nine neuf neun nueve",
}
#: Words for the signs of addresses.
AT_WORDS, DOT_WORDS, PLUS_WORDS = "at arobase arroba klammeraffe", "dot point punkt punto", "plus más"
#: Letters of other scripts that look like Latin ones.
HOMOGLYPHS = dict(
    zip(
        "АВЕКМНОРСТУХаеорсухіјѕԁһԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧοαινρτυχ",
        "ABEKMHOPCTYXaeopcyxijsdhqwABEZHIKMNOPTYXoaivptux",
        strict=True,
    )
)
_INVISIBLE = "­​‌‍⁠﻿"
# letters that a pattern without case takes for i and s, though lower() keeps them
_FOLDED = str.maketrans("İıſ", "iis")
_DIGIT_OF = {w: d for d, words in DIGIT_WORDS.items() for w in words.split()}
# by first letter, then the longest first
_NUMBER = "|".join(a + "(?:" + "|".join(w[1:] for w in sorted(_DIGIT_OF, key=len, reverse=True) if w[0] == a) + ")" for a in sorted({w[0] for w in _DIGIT_OF}))
_FIRST = "[" + "".join(sorted({w[0] for w in _DIGIT_OF})) + "]"
_AT, _DOT, _PLUS = (s.replace(" ", "|") for s in (AT_WORDS, DOT_WORDS, PLUS_WORDS))
#: Words for mail in English, French, German and Spanish, and the commonest ends of host names.
MAIL_WORDS = frozenset("mail email mailto e-mail write contact reach send schreib schreibe kontakt courriel écrire écrivez correo escribe contacto".split())
HOST_ENDS = frozenset("com org net edu gov info io co de fr es uk eu us ch at it nl".split())
_BLANKS = r"[\x20\t]"
_GAP = rf"{_BLANKS}*+(?:[,;/-]{_BLANKS}*+)?"
_STRANGE = re.compile("[" + _INVISIBLE + "Ͱ-ϿЀ-ԯ٠-٩۰-۹०-९․⁰-⁹₀-₉。﹒﹫！-～\U0001d400-\U0001d7ff]")
_BRACKETED = rf"[(\[{{{{<]{_BLANKS}*+(?:{{0}}){_BLANKS}*+[)\]}}}}>]{_BLANKS}*+"
_SINGLE = r"[A-Za-z0-9._-]"
_SPACED = rf"{_SINGLE}(?:\x20{_SINGLE})++(?=\x20?[@(\[{{<])"
_SPACED_FIRST = re.compile(rf"(?P<spaced>{_SPACED})")
#: The transducer's rules, tried in this order at each place. The lookaheads only spare tries that must fail, and repeats
#: that could be tried in two ways give nothing back.
_RULES = re.compile(
    rf"(?i)(?:(?=[(\[{{<@_-]|{_BLANKS}(?:[@.]|{_AT}|{_DOT}|{_SINGLE}\x20))(?:"
    + "|".join(
        [
            rf"(?P<at>{_BRACKETED.format(_AT + '|@')}|(?<=[a-z0-9])[_-](?:{_AT})[_-](?=[a-z0-9])|{_BLANKS}@{_BLANKS}*+(?=[a-z0-9])|(?<=[a-z0-9])@{_BLANKS}++(?=[a-z0-9-]++{_BLANKS}*+[\[(.]))",
            rf"(?P<dot>{_BRACKETED.format(_DOT + '|[.]')}|(?<=[\w)\]}}])[_\x20-](?:{_DOT})[_\x20-](?=\w))",
            rf"(?P<wordat>{_BLANKS}(?:{_AT}){_BLANKS}++(?=[\w.-]+?(?:{_BLANKS}++[\[({{<]?|_|[\[({{<-]){_BLANKS}*+(?:{_DOT})\b))",
            rf"(?P<hostat>{_BLANKS}(?:{_AT}){_BLANKS}++(?=[a-z0-9-]++(?:\.[a-z0-9-]++)++))",
            rf"(?P<loose>{_BLANKS}\.{_BLANKS}++(?=[a-z0-9]))",
            rf"(?P<spaced>{_BLANKS}(?<![^\w.-]{_SINGLE}{_BLANKS})(?<!\A{_SINGLE}{_BLANKS}){_SPACED})",
        ]
    )
    + ")|"
    + "|".join(
        [
            rf"(?P<plus>\b(?:{_PLUS}){_BLANKS}++(?=(?:[0-9]|{_NUMBER})))",
            rf"(?P<number>\b(?={_FIRST})(?:{_NUMBER})(?:{_GAP}(?:{_NUMBER}))*\b)",
            rf"(?P<glyph>{_STRANGE.pattern})",
            r"(?P<blur>(?<=[0-9])[OoIl|]++(?=[\x20-]?[0-9])|(?<=[0-9][\x20-])[OoIl|]++(?=[\x20-]?[0-9]))",
        ]
    )
    + ")"
)
#: Rules that also take the blanks before them.
_TAKES_BLANKS = frozenset(("at", "dot", "wordat", "hostat", "loose"))
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\Z")
_LABEL = re.compile(r"[A-Za-z0-9-]+")


def luhn(digits: str) -> bool:
    """The check sum of payment cards."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def plain_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of undisguised identifiers: leftmost, not overlapping within a kind; failing matches drop out."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16 and 16 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def _glyph(c: str) -> str:
    if c in _INVISIBLE:
        return ""
    return HOMOGLYPHS.get(c) or {"。": ".", "․": "."}.get(c) or unicodedata.normalize("NFKD", c)


def _write(m: re.Match) -> str:
    kind, text = m.lastgroup, m[0]
    if kind in ("at", "wordat", "hostat"):
        return "@"
    if kind in ("dot", "loose"):
        return "."
    if kind == "spaced":
        return text.replace(" ", "").replace("\t", "")
    if kind == "plus":
        return "+"
    if kind == "number":
        return "".join(_DIGIT_OF[w.translate(_FOLDED).lower()] for w in re.findall(r"(?i)" + _NUMBER, text))
    if kind == "blur":
        return "".join("0" if c in "Oo" else "1" for c in text)
    out = _glyph(text)
    return str(unicodedata.digit(text)) if out and unicodedata.digit(out[0], None) is not None and not out[0].isascii() else out


def _is_named(text: str, end: int) -> bool:
    """Whether the word that ends here is a name before a host: by its own signs, or by a word for mail before it."""
    start = end
    while start > 0 and text[start - 1] in _LOCAL:
        start -= 1
    name = text[start:end].strip(".")
    if any(not c.isalpha() for c in name):
        return any(c.isalpha() for c in name)
    near = text[max(0, start - 40) : start].replace(":", " ").lower().split()
    return bool(name) and any(w in MAIL_WORDS for w in near[-2:])


def transduce(text: str) -> tuple[str, list[tuple[int, int, int, int]]]:
    """The rewritten text and its pieces (start, end, source start, source end), rewritten ones only."""
    out, pieces, done, at, place, held, kind = [], [], 0, 0, 0, "", ""
    first = _SPACED_FIRST.match(text)
    while m := (not place and first) or _RULES.search(text, place):
        start, was = m.start(), kind
        kind = m.lastgroup
        if kind in _TAKES_BLANKS:
            while start > done and text[start - 1] in " \t":
                start -= 1
        elif kind == "spaced" and m is not first:
            start += 1  # after the blank
        before = text[start - 1 : start] if start > done else held[-1:]
        good = True
        if kind == "at" and m[0][0] in " \t":
            good = before.isascii() and before.isalnum()
        elif kind == "wordat":
            good = before == "_" or before.isalnum() or before in (")", "]")
        elif kind == "hostat":
            good = _is_named(text, start)
        elif kind == "loose":
            # between the numbers of an address, or in the host that follows an at sign
            follows = _LABEL.match(text, m.end())[0]
            good = (before.isdigit() and follows.isdigit()) or (was in ("at", "wordat", "loose") and follows.lower() in HOST_ENDS and bool(_HOST.match(text[done:start])))
        if not good:
            kind, place = was, m.start() + 1
            continue
        new = _write(m)
        if start > done:
            out.append(text[done:start])
            at += start - done
        pieces.append((at, at + len(new), start, m.end()))
        out.append(new)
        at += len(new)
        done = place = m.end()
        held = new or held
    out.append(text[done:])
    return "".join(out), pieces


def _source(at: int, pieces: list, starts: list[int], end: bool) -> int:
    """The source offset of a bound of a find in the rewritten text."""
    i = bisect_right(starts, at - end) - 1
    if i < 0:
        return at
    a, b, s, e = pieces[i]
    if a <= at - end < b:
        return e if end else s
    return e + at - b


def find_spans(text: str | None) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, plain) in order of kind, then start."""
    text = text or ""
    plain = plain_spans(text)
    out = [(*x, True) for x in plain]
    rewritten, pieces = transduce(text)
    if rewritten != text:
        # a rewritten text can hide another disguise under homoglyphs: spelled words, signs
        again, more = transduce(rewritten) if any(not c.isascii() for c in text) else (rewritten, [])
        starts, starts_again = [p[0] for p in pieces], [p[0] for p in more]
        taken = {kind: [(a, b) for k, a, b in plain if k == kind] for kind in KINDS}
        for kind, a, b in plain_spans(again):
            a, b = (_source(x, more, starts_again, end) for x, end in ((a, False), (b, True)))
            a, b = (_source(x, pieces, starts, end) for x, end in ((a, False), (b, True)))
            while a < b and text[a].isspace():
                a += 1
            while b > a and text[b - 1].isspace():
                b -= 1
            # plain finds of a kind do not overlap: only the last one that begins before the end can meet this one
            at = bisect_left(taken[kind], (b,)) - 1
            if at < 0 or taken[kind][at][1] <= a:
                out.append((kind, a, b, False))
    return sorted(out, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


def pii_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, spans: array of (kind, start, end, plain) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("plain", pa.bool_())]))
        for batch in batches:
            spans = [[{"kind": k, "start": a, "end": b, "plain": p} for k, a, b, p in find_spans(x.as_py())] for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], names=["doc_id", "spans"])

    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return own.mapInArrow(run, f"doc_id {dict(own.dtypes)['doc_id']}, spans array<struct<kind:string,start:int,end:int,plain:boolean>>")
