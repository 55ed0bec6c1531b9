"""Two-stage suffix sorting of short strings, in numpy.

Only suffixes that are smaller than their successor are compared with each other. A larger one is its first
byte and a suffix already placed, so the rest falls into place by one scan over the buckets of first bytes.
"""

from __future__ import annotations

import numpy as np


def _direct(data: bytes, ends: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``at`` in the order of the suffixes that begin there, each up to its own string's end; ties by place."""
    keys = [(data[a:e], a) for a, e in zip(at.tolist(), ends.tolist())]
    keys.sort()
    return np.array([a for _, a in keys], np.int64)


def sorted_starts(strings: list[bytes], least: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes with at least ``least`` bytes of all strings, in order: their places in the joined strings;
    with them the joined strings' offsets.

    A suffix ends with its string; of equal ones the earlier comes first.
    """
    sizes = np.array([len(s) for s in strings], np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    joined = b"".join(strings)
    data = np.frombuffer(joined, np.uint8)
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), offsets
    places = np.arange(n, dtype=np.int32)
    owner = np.repeat(np.arange(len(strings), dtype=np.int32), sizes)
    ends = offsets[1:].astype(np.int32)[owner]
    left = ends - places
    wanted = left >= least
    # Smaller than the successor, decided from the right within each string; the empty suffix is the smallest of all.
    first = data.astype(np.int16)
    after = np.append(first[1:], np.int16(-1))[:n]
    after[offsets[1:][sizes > 0] - 1] = -1
    following = np.where(first != after, places, np.int32(n))
    following = np.minimum.accumulate(following[::-1])[::-1]
    smaller = first[following] < after[following]
    # The scan reaches a long enough suffix from the next smaller one, which may lie some bytes beyond the last of them.
    next_smaller = np.minimum.accumulate(np.where(smaller, places, np.int32(n))[::-1])[::-1]
    beyond = (left < least) & (places <= next_smaller[np.maximum(ends - least, 0)])
    needed = wanted | beyond & (sizes[owner] >= least)
    direct = np.flatnonzero(needed & smaller)
    direct = _direct(joined, ends[direct], direct)
    induced = np.flatnonzero(needed & ~smaller)
    rank = np.full(n + 1, -1, np.int32)
    by_byte = induced[np.argsort(first[induced], kind="stable")]
    bounds = np.searchsorted(first[by_byte], np.arange(257))
    direct_bounds = np.searchsorted(first[direct], np.arange(257)) if len(direct) else np.zeros(257, np.int64)
    placed, next_rank = [], 0
    for c in range(256):
        # Larger than their successors: by the successors' order; a run of one byte takes a wave per byte.
        own = by_byte[bounds[c]:bounds[c + 1]]
        wave = own[after[own] < c]
        rest = own[after[own] == c]
        while len(wave):
            wave = wave[np.lexsort((wave, np.where(wave + 1 == ends[wave], -1, rank[wave + 1])))]
            rank[wave] = np.arange(next_rank, next_rank + len(wave))
            next_rank += len(wave)
            placed.append(wave)
            ready = rank[rest + 1] >= 0
            wave, rest = rest[ready], rest[~ready]
        own = direct[direct_bounds[c]:direct_bounds[c + 1]]
        rank[own] = np.arange(next_rank, next_rank + len(own))
        next_rank += len(own)
        placed.append(own)
    order = np.concatenate(placed) if placed else np.zeros(0, np.int64)
    return order[wanted[order]], offsets


def repeated_starts(strings: list[bytes], least: int) -> list[np.ndarray]:
    """For each string, the places at which a run of ``least`` bytes begins that also begins elsewhere in ``strings``.

    Neighbours in suffix order are compared eight bytes at a time; a repeated run has an equal neighbour.
    """
    order, offsets = sorted_starts(strings, least)
    data = np.frombuffer(b"".join(strings) + b"\0" * 8, np.uint8)
    a, b = order[:-1], order[1:]
    for step in [*range(0, least - 7, 8), *([least - 8] if least % 8 and least >= 8 else [])]:
        same = _word(data, a + step) == _word(data, b + step)
        a, b = a[same], b[same]
    if least < 8:
        same = np.array([data[x:x + least].tobytes() == data[y:y + least].tobytes() for x, y in zip(a, b)], bool)
        a, b = a[same], b[same]
    found = np.unique(np.concatenate([a, b]))
    cut = np.searchsorted(found, offsets)
    return [found[i:j] - start for i, j, start in zip(cut[:-1], cut[1:], offsets)]


def _word(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each place, as one number."""
    words = np.lib.stride_tricks.sliding_window_view(data, 8)[at]
    return np.ascontiguousarray(words).view(np.uint64)[:, 0]
