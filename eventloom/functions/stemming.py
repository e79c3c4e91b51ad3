"""Stems of English and German words by the published Snowball rules."""

from __future__ import annotations

import re
from functools import lru_cache

_VOWELS = "aeiouy"
#: Fixed values of the English rules: words with a stem of their own, and words that stay from a step on.
SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    **{w: w for w in "sky news howe atlas cosmos bias andes".split()},
}
STAYS = frozenset("inning outing canning herring earring proceed exceed succeed".split())
#: Endings and what stands for them, the longest first; the mark @ is a condition that the code states.
STEP_2 = (
    ("ational", "ate"), ("fulness", "ful"), ("iveness", "ive"), ("ization", "ize"), ("ousness", "ous"), ("biliti", "ble"), ("lessli", "less"), ("tional", "tion"), ("alism", "al"), ("aliti", "al"),
    ("ation", "ate"), ("entli", "ent"), ("fulli", "ful"), ("iviti", "ive"), ("ousli", "ous"), ("abli", "able"), ("alli", "al"), ("anci", "ance"), ("ator", "ate"), ("enci", "ence"), ("izer", "ize"),
    ("bli", "ble"), ("ogi", "@og"), ("li", "@"),
)
STEP_3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", "@"), ("ical", "ic"), ("ness", ""), ("ful", ""))
STEP_4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")
_SHORT = re.compile(r"(?:^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$")


def _regions(word: str, vowels: str) -> tuple[int, int]:
    """Where R1 and R2 begin: each after the first non-vowel that follows a vowel, R2 within R1."""
    at, out = 0, []
    for _ in range(2):
        m = re.compile(f"[{vowels}][^{vowels}]").search(word, at)
        at = m.end() if m else len(word)
        out.append(at)
    return out[0], out[1]


@lru_cache(maxsize=100_000)
def english(word: str) -> str:
    word = word.lower().lstrip("'")
    if len(word) <= 2:
        return word
    if word in SPECIAL:
        return SPECIAL[word]
    word = re.sub(r"(^|[aeiouy])y", r"\1Y", word)
    prefix = re.match("gener|commun|arsen", word)
    r1, r2 = _regions(word, _VOWELS)
    if prefix:
        r1 = prefix.end()
        m = re.compile(f"[{_VOWELS}][^{_VOWELS}]").search(word, r1)
        r2 = m.end() if m else len(word)
    word = re.sub(r"'s'$|'s$|'$", "", word)
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and re.search(f"[{_VOWELS}]", word[:-2]):
        word = word[:-1]
    if word in STAYS:
        return word
    m = re.search(r"(eedly|eed|ingly|edly|ing|ed)$", word)
    if m and m[1] in ("eed", "eedly"):
        if m.start() >= r1:
            word = word[: m.start()] + "ee"
    elif m and re.search(f"[{_VOWELS}]", word[: m.start()]):
        word = word[: m.start()]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", word):
            word = word[:-1]
        elif r1 >= len(word) and _SHORT.search(word):
            word += "e"
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in _VOWELS:
        word = word[:-1] + "i"
    for end, new in STEP_2:
        if word.endswith(end):
            at = len(word) - len(end)
            if at >= r1 and (end != "ogi" or word[at - 1 : at] == "l") and (end != "li" or word[at - 1 : at] in tuple("cdeghkmnrt")):
                word = word[:at] + new.lstrip("@")
            break
    for end, new in STEP_3:
        if word.endswith(end):
            at = len(word) - len(end)
            if at >= (r2 if end == "ative" else r1):
                word = word[:at] + new.lstrip("@")
            break
    for end in STEP_4:
        if word.endswith(end):
            at = len(word) - len(end)
            if at >= r2 and (end != "ion" or word[at - 1 : at] in ("s", "t")):
                word = word[:at]
            break
    last = len(word) - 1
    if word.endswith("e") and (last >= r2 or (last >= r1 and not _SHORT.search(word[:-1]))):
        word = word[:-1]
    elif word.endswith("ll") and last >= r2:
        word = word[:-1]
    return word.replace("Y", "y")


_GERMAN_VOWELS = "aeiouyäöü"


@lru_cache(maxsize=100_000)
def german(word: str) -> str:
    word = word.lower().replace("ß", "ss")
    word = re.sub(f"(?<=[{_GERMAN_VOWELS}])([uy])(?=[{_GERMAN_VOWELS}])", lambda m: m[1].upper(), word)
    r1, r2 = _regions(word, _GERMAN_VOWELS)
    r1 = max(r1, 3)
    m = re.search(r"(ern|em|er|en|es|e|s)$", word)
    if m and m.start() >= r1:
        if m[1] != "s":
            word = word[: m.start()]
            if m[1] in ("e", "en", "es") and word.endswith("niss"):
                word = word[:-1]
        elif word[m.start() - 1] in "bdfghklmnrt":
            word = word[:-1]
    m = re.search(r"(est|en|er|st)$", word)
    if m and m.start() >= r1 and (m[1] != "st" or (m.start() > 3 and word[m.start() - 1] in "bdfghklmnt")):
        word = word[: m.start()]
    m = re.search(r"(isch|lich|heit|keit|end|ung|ig|ik)$", word)
    if m and m.start() >= r2:
        end, at = m[1], m.start()
        if end in ("end", "ung"):
            word = word[:at]
            if word.endswith("ig") and at - 2 >= r2 and word[at - 3 : at - 2] != "e":
                word = word[:-2]
        elif end in ("ig", "ik", "isch"):
            if word[at - 1 : at] != "e":
                word = word[:at]
        elif end in ("lich", "heit"):
            word = word[:at]
            if word.endswith(("er", "en")) and at - 2 >= r1:
                word = word[:-2]
        else:
            word = word[:at]
            for tail in ("lich", "ig"):
                if word.endswith(tail) and at - len(tail) >= r2:
                    word = word[: -len(tail)]
                    break
    return word.lower().translate(str.maketrans("äöü", "aou"))


def language_of(text: str) -> str:
    """The rule where nothing else tells: german if there is an umlaut or ß, else english."""
    return "german" if any(c in text.lower() for c in "äöüß") else "english"


STEMMERS = {"english": english, "german": german}
