"""Texts as arrays of small letter codes, for operators that score every character without a Python loop.

Words are made of Unicode letters and combining marks. Codes: 0 other, 1 white space, 2-27 a to z, 28-63 other letters
(after lower-casing; a letter outside Latin-1 shares its code with others of the same residue).
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

ALPHABET = 64
CHUNK = 1 << 19
#: First and last code points of the scripts that are told apart.
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F)],
    "devanagari": [(0x900, 0x97F)],
    "thai": [(0xE00, 0xE7F)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x3FFFF)],
}
SCRIPT_NAMES = ("other", *SCRIPTS)


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letter codes, script numbers, and whether it is a letter proper, of all code points below 0x40000, where letters end."""
    code, script, proper = np.zeros(0x40000, dtype=np.uint8), np.zeros(0x40000, dtype=np.uint8), np.zeros(0x40000, dtype=bool)
    for i, ranges in enumerate(SCRIPTS.values(), 1):
        for a, b in ranges:
            script[a : b + 1] = i
    for c in range(0x3FFFF):
        x = chr(c)
        if x.isspace():
            code[c] = 1
        elif unicodedata.category(x)[0] in "LM":
            low = ord(x.lower()[0])
            code[c] = low - 95 if 97 <= low <= 122 else 28 + low % 36
            proper[c] = unicodedata.category(x)[0] == "L"
    return code, script, proper


def codepoints(texts: list[str]) -> np.ndarray:
    """Code points of the texts, each followed by a newline."""
    data = "\n".join(texts) + "\n"
    return np.minimum(np.frombuffer(data.encode("utf-32-le" if sys.byteorder == "little" else "utf-32-be", "surrogatepass"), dtype=np.uint32), 0x3FFFF)


def text_batches(column: pa.Array, size: int = CHUNK) -> Iterator[list[str]]:
    """The texts in order, in lists of about ``size`` characters; null is empty."""
    held, n = [], 0
    for x in column:
        x = x.as_py() or ""
        if held and n + len(x) > size:
            yield held
            held, n = [], 0
        held.append(x)
        n += len(x) + 1
    if held:
        yield held


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return edges[0::2], edges[1::2]
