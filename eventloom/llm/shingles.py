"""Word-shingle sets of whole texts, in NumPy over UTF-8 bytes.

Words are runs of bytes other than the six white-space bytes after ASCII lower-casing, which is exactly the split into
``[^\\x20\\x09-\\x0D]+`` of the A-Z-lower-cased text: UTF-8 never has such a byte inside another character. A word is
hashed to 64 bits by a polynomial over a table of byte values, a shingle by a mix of its words' hashes; equal words
always have equal hashes, and the hashes are the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
_U = np.uint64
_BASE, _BASE_INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_MULTIPLIERS = np.array([0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=_U)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> _U(31))
    x = x * _U(0x7FB5D329728EA185)
    x = x ^ (x >> _U(27))
    x = x * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


_BYTES = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = [np.ones(1, dtype=_U), np.ones(1, dtype=_U)]


def _powers_to(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(size, base, dtype=_U)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=_U)
    return _powers


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and the bounds of each text's words in them."""
    data = np.frombuffer(b" ".join(texts).lower() + b" ", dtype=np.uint8)
    power, inverse = _powers_to(len(data) + 1)
    space = _IS_SPACE[data]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edges = np.concatenate([np.zeros(1, dtype=edges.dtype), edges])
    starts, ends = edges[0::2], edges[1::2]
    sums = np.zeros(len(data) + 1, dtype=_U)
    np.cumsum(_BYTES[data] * power[: len(data)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(_U))
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])
    return hashes, np.searchsorted(starts, begins)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word shingles of one text's words, in order; fewer words give one hash of all of them."""
    k = min(k, len(words))
    if not k:
        return words
    total = np.full(len(words) - k + 1, k, dtype=_U)
    for i in range(k):
        total = (total + words[i : len(words) - k + 1 + i]) * _MULTIPLIERS[i % len(_MULTIPLIERS)]
        total ^= total >> _U(29)
    return mix(total)


def text_chunks(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) of at most about ``size`` bytes each; null is empty."""
    held, bytes_held, first = [], 0, 0
    for i, x in enumerate(column.cast(pa.large_binary())):
        x = x.as_py() or b""
        if held and bytes_held + len(x) > size:
            yield first, held
            held, bytes_held, first = [], 0, i
        held.append(x)
        bytes_held += len(x) + 1
    if held:
        yield first, held


def shingle_groups(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Shingle hashes of many rows at a time, repeats within a row included."""
    for _, texts in text_chunks(column):
        hashes, bounds = word_hashes(texts)
        held = [shingle_hashes(hashes[a:b], k) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True) if b > a]
        if held:
            yield np.concatenate(held)


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each row, its sorted distinct shingle hashes; empty for null and wordless texts."""
    for _, texts in text_chunks(column):
        hashes, bounds = word_hashes(texts)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            yield np.unique(shingle_hashes(hashes[a:b], k))


def signature(s: np.ndarray) -> int:
    """A signed even 64-bit value of a sorted set, so its lowest bit is free for a mark; 0 only for the empty set."""
    if not len(s):
        return 0
    spread = mix(s + _U(len(s)))
    value = int(mix(np.array([(int(spread.sum(dtype=_U)) ^ int(np.bitwise_xor.reduce(mix(spread + _U(7)))) + len(s)) & (2**64 - 1)], dtype=_U))[0])
    value = value & ~1 or 2
    return value - (1 << 64 if value >= 1 << 63 else 0)
