"""Word shingles of many texts at once, as 64-bit hashes."""

from __future__ import annotations

import numpy as np

_PRIME = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_PRIME), -1, 1 << 64))

# Bytes that end a word, and A-Z to a-z.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, text after text, and where each text's begin (with the end)."""
    data = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    inside = ~_SPACE[data]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, stops = edges[::2], edges[1::2]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_PRIME, len(data)), out=sums[1:])
    hashes = mixed((sums[stops] - sums[starts]) * _powers(_INVERSE, len(data) + 1)[starts])
    lengths = np.array([len(t) + 1 for t in texts])
    begins = np.searchsorted(starts, np.concatenate([[0], np.cumsum(lengths)]))
    return hashes, begins


def shingle_sets(texts: list[str], words: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's runs of ``words`` words; of a shorter text's whole sequence; none without a word."""
    if not texts:
        return []
    hashes, begins = word_hashes([t.encode() for t in texts])
    out, factors = [], _powers(_PRIME, words + 1)[1:]
    n = max(0, len(hashes) - words + 1)
    runs = np.zeros(n, np.uint64)
    for k in range(words):
        runs += hashes[k:k + n] * factors[k]
    runs = mixed(runs)
    for a, b in zip(begins[:-1], begins[1:]):
        if b - a >= words:
            out.append(np.unique(runs[a:b - words + 1]))
        elif b > a:
            whole = (hashes[a:b] * factors[:b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mixed(np.array([whole], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
