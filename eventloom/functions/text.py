"""Scalar text functions as columns; Arrow functions only where Java and Python disagree on characters."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column
from pyspark.sql import functions as F

from eventloom.functions.blocks import mapped

#: The punctuation of ASCII.
PUNCTUATION = r"[!-/:-@\[-`{-~]"


#: The characters that Unicode counts as white space.
WHITE_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column | str) -> Column:
    """The text without white space at its ends, whatever white space it is."""
    return F.trim(F.col(text) if isinstance(text, str) else text, F.lit(WHITE_SPACE))


def split_list(text: Column, sep: str = ",") -> Column:
    """Trimmed, non-empty parts."""
    return F.filter(F.transform(F.split(text, sep), strip), lambda x: x != "")


def join_list(items: Column) -> Column:
    """Parts that are not blank joined by "; ", or "-" if there are none."""
    kept = F.array_join(F.filter(items, lambda x: x.isNotNull() & (strip(x) != "")), "; ")
    return F.coalesce(F.when(kept != "", kept), F.lit("-"))


def join_numbers(items: Column) -> Column:
    """(value, explanation) pairs as "value (explanation)", joined by "; "; a missing value prints as None."""
    shown = F.transform(
        F.filter(items, lambda n: n.value.isNotNull() | n.explanation.isNotNull()),
        lambda n: F.concat(F.coalesce(n.value, F.lit("None")), F.when(F.coalesce(n.explanation, F.lit("")) != "", F.concat(F.lit(" ("), n.explanation, F.lit(")"))).otherwise("")),
    )
    joined = F.array_join(shown, "; ")
    return F.coalesce(F.when(joined != "", joined), F.lit("-"))


def fill(template: str, **values: Column) -> Column:
    """The template with $name and ${name} replaced in one pass; unknown names stay, $$ is a dollar sign."""
    from string import Template

    parts: list[Column] = []
    done = 0
    for m in Template.pattern.finditer(template):
        parts.append(F.lit(template[done : m.start()]))
        name = m["named"] or m["braced"]
        parts.append(F.lit("$") if m["escaped"] is not None else F.coalesce(values[name].cast("string"), F.lit("")) if name in values else F.lit(m[0]))
        done = m.end()
    return F.concat(*parts, F.lit(template[done:]))


def star_number(text: Column) -> Column:
    """The number of a trailing *number*, a decimal comma allowed; null if there is none."""
    found = F.regexp_extract(strip(text), r"\*([+-]?[0-9]+(?:[.,][0-9]+)?)\*\s*$", 1)
    return F.when(found != "", F.replace(found, F.lit(","), F.lit(".")).cast("double"))


def truth(value: Column) -> Column:
    """0 or 1 for numbers within 1e-12 of them, also as text or boolean; else null."""
    number = strip(value.cast("string")).try_cast("double") if not isinstance(value, str) else None
    number = F.coalesce(number, F.when(F.lower(value.cast("string")) == "true", 1.0).when(F.lower(value.cast("string")) == "false", 0.0))
    return F.when(F.abs(number) < 1e-12, 0.0).when(F.abs(number - 1) < 1e-12, 1.0)


def questions(text: Column) -> Column:
    """The questions of bulleted "Question n: ..." lines, bold marks removed."""
    return F.transform(F.regexp_extract_all(F.replace(text, F.lit("**"), F.lit("")), F.lit(r"[-*•]\s*Question\s*[0-9]+\s*:\s*([^\n]+)"), 1), strip)


def head_tail(text: Column, total: int = 200, skip: int = 1000) -> Column:
    """The trimmed text if it has at most ``total`` white-space tokens; else half of them from offset ``skip`` (or less,
    to be whole) and half that end ``skip`` before the end (or at the end of a shorter text)."""
    tokens = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda t: t != "")
    half = max(1, total // 2)

    def cut(t: Column) -> Column:
        n = F.size(t)
        head = F.slice(t, F.least(F.lit(skip), n - half) + 1, F.lit(half))
        tail = F.slice(t, F.when(n > half + skip, n - half - skip).otherwise(n - half) + 1, F.lit(half))
        return F.when(n <= total, strip(F.coalesce(text, F.lit("")))).otherwise(F.array_join(F.concat(head, tail), " "))

    return F.transform(F.array(tokens), cut)[0]


_stop: list[frozenset] = []


def stop_words() -> frozenset:
    """English and German stop words of the Spark distribution; loaded on the driver."""
    if not _stop:
        _stop.append(frozenset(StopWordsRemover.loadDefaultStopWords("english")) | frozenset(StopWordsRemover.loadDefaultStopWords("german")))
    return _stop[0]


def embed_clean(text: Column) -> Column:
    """Text for an embedder: NFKD, lower case, no ASCII punctuation, digits and white space as one blank, no stop words.

    Only NFKD leaves the JVM, in Arrow batches; ASCII text would not need it.
    """

    nfkd = mapped(text, lambda x: x if x.isascii() else unicodedata.normalize("NFKD", x), "string", pa.string())
    plain = F.regexp_replace(F.regexp_replace(F.lower(nfkd), PUNCTUATION, ""), r"(?U)\d+|\s+", " ")
    words = sorted(stop_words())
    return F.array_join(F.filter(F.split(F.trim(plain), " +"), lambda w: (w != "") & ~w.isin(*words)), " ")
