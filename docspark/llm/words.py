"""Words and word n-grams of many texts at once, as 64-bit hashes in numpy arrays.

Words are maximal runs of bytes other than space and 0x09-0x0D.  A word's hash is a polynomial of its bytes
modulo 2**64, mixed; an n-gram's hash mixes its words' hashes in order.  Distinct n-grams of a corpus of
10**12 collide within one pair of texts of a thousand n-grams with a chance under 10**-13.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_POWERS = np.ones(1, U)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def text_groups(texts: list, size: int = 400_000):
    """The texts in groups of about ``size`` characters (one text at least), in order: what is worked on at once."""
    group, n = [], 0
    for t in texts:
        group.append(t)
        n += len(t or "")
        if n >= size:
            yield group
            group, n = [], 0
    if group:
        yield group


def _powers(n: int) -> np.ndarray:
    global _POWERS
    while len(_POWERS) < n:
        more = _POWERS * U(pow(_BASE, len(_POWERS), 1 << 64))
        _POWERS = np.concatenate([_POWERS, more])
    return _POWERS


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): text i's words hash to ``hashes[bounds[i]:bounds[i + 1]]``."""
    buf = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    gap = _SPACE[buf]
    edges = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    text_at = np.concatenate([[1], 1 + np.cumsum(sizes + 1)])
    bounds = np.searchsorted(starts, text_at)
    if not len(starts):
        return np.zeros(0, U), bounds
    lengths = ends - starts
    at = np.flatnonzero(~gap)
    inside = np.arange(len(at), dtype=np.int64)
    firsts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    place = inside - np.repeat(firsts, lengths)
    terms = (buf[at].astype(U) + U(1)) * _powers(int(lengths.max()))[place]
    sums = np.add.reduceat(terms, firsts)
    return mix(sums ^ (lengths.astype(U) << U(48))), bounds


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams of one run of words (or of several laid end to end; the caller drops those that cross)."""
    if len(words) < n:
        return np.zeros(0, U)
    last = len(words) - n + 1
    h = words[:last].copy()
    for i in range(1, n):
        h = mix(h * U(0xD6E8FEB86659FD93) + words[i : i + last])
    return h
