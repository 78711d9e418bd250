"""Vectorized hashing of words and word shingles in UTF-8 buffers (numpy, 64-bit wrap-around arithmetic)."""

from __future__ import annotations

import re

import numpy as np

_RNG = np.random.default_rng(20240229)
BYTE_VALUE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
STEP = 0xD6E8FEB86659FD93
CHUNK_BYTES = 2 << 20
ASCII_SPACE = np.zeros(256, bool)
ASCII_SPACE[[32, *range(9, 14)]] = True
#: Everything but digits, a-z and non-ASCII bytes becomes a blank; texts are lower-cased before.
PLAIN = bytes(b if 48 <= b < 58 or 97 <= b < 123 or b > 127 else 32 for b in range(256))
_POWERS: dict[str, np.ndarray] = {}


def _powers(name: str, base: int, n: int) -> np.ndarray:
    have = _POWERS.get(name)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        have = _POWERS[name] = np.multiply.accumulate(steps)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def word_spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and exclusive ends of the runs of True."""
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(data: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of every word: a polynomial of its bytes, from one running sum."""
    starts, ends = word_spans(inside)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends
    terms = BYTE_VALUE[data] * _powers("up", BASE, len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(terms, out=sums[1:])
    h = (sums[ends] - sums[starts]) * _powers("down", INVERSE, len(data))[starts]
    return mix(h), starts, ends


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on; the last k-1 positions are left out."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * np.uint64(STEP) + words[j : j + n]
    return mix(h)


_SPACE = re.compile(rb"[ \t-\r]")


def space_cut(text: bytes, at: int) -> int:
    """The first white space at or after a position, or the text's end."""
    m = _SPACE.search(text, at) if at < len(text) else None
    return m.start() if m else len(text)


def chunks(texts: list[bytes], limit: int = CHUNK_BYTES):
    """(first, last) index ranges of texts that fit in limit bytes together; a longer text stands alone."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) + 1 > limit:
            yield first, i
            first, size = i, 0
        size += len(t) + 1
    if first < len(texts):
        yield first, len(texts)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One buffer of the texts with a blank after each, and where each begins, with the end appended."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    begins = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=begins[1:])
    return data, begins
