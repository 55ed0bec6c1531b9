"""Packing documents into sequences of a fixed length by bin completion.

Pieces of equal length are interchangeable, so the search runs over the counts of lengths, of which there
are at most ``capacity``, however many documents there are. Best fit decreasing gives the first
solution; bin completion then takes the longest piece left, enumerates the undominated fillings of the
room beside it, least waste first, completes each by best fit, and drops a branch when its waste so far cannot beat
the best solution. The search takes a fixed number of steps at most. A solution is a list of fillings with the number of times each is used; documents find their
places by their rank among the pieces of their length, which is counted in parallel.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from sightline.llm.common import narrowed, written
from sightline.llm.words import WordEncoder, portions, vocabulary_path

Filling = tuple[tuple[int, int], ...]  # ((length, times in the bin), ...), longest first
# Lengths that the search may look at in all: some seconds on the driver.
MAX_STEPS = 4_000_000
# Every so many levels the rest is packed by best fit; so many levels are held open.
COMPLETE_EVERY, OPEN_LEVELS = 16, 32


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Filling, int]]:
    """Best fit decreasing over counts; bins with equal contents are handled together."""
    rooms: dict[int, list[tuple[Filling, int]]] = {}
    order: list[int] = []  # rooms with bins, ascending

    def put(room: int, filling: Filling, bins: int) -> None:
        if room not in rooms:
            rooms[room] = []
            insort(order, room)
        rooms[room].append((filling, bins))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(order, length)
            if at == len(order):
                each = min(capacity // length, left)
                put(capacity - each * length, ((length, each),), left // each)
                left %= each
                continue
            room = order[at]
            filling, bins = rooms[room].pop()
            if not rooms[room]:
                del rooms[room], order[at]
            each = min(room // length, left)
            used = min(bins, left // each)
            if bins > used:
                put(room, filling, bins - used)
            put(room - each * length, (*filling, (length, each)), used)
            left -= used * each
    return [x for room in order for x in rooms[room]]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Bins that any packing needs: pieces over half stand alone, and rooms beside long ones stay empty
    as far as nothing short enough is left.
    """
    lengths = sorted(counts)
    bound = -(-sum(n * c for n, c in counts.items()) // capacity)
    for small in [0, *[n for n in lengths if 2 * n <= capacity]]:
        alone = sum(counts[n] for n in lengths if n > capacity - small)
        halves = [n for n in lengths if capacity - small >= n > capacity / 2]
        room = sum((capacity - n) * counts[n] for n in halves)
        rest = sum(n * counts[n] for n in lengths if small <= n <= capacity / 2)
        bound = max(bound, alone + sum(counts[n] for n in halves) + max(0, -(-(rest - room) // capacity)))
    return bound


class Steps:
    """What a search may still do: lengths looked at, in whatever part of it."""

    def __init__(self, limit: int):
        self.left = limit


def fillings(counts: dict[int, int], room: int, most_waste: int, steps: Steps) -> Iterator[Filling]:
    """Undominated ways to fill ``room``, least waste first: nothing left fits, and no piece can be exchanged for a longer
    one left. Ends after ``most_waste``, or when no steps are left.

    For every waste, sums that the shorter lengths can reach tell which branches end in a filling. Longer lengths are
    settled first, so a piece that a longer free one could replace is refused before anything is put beside it.
    """
    lengths = sorted((n for n, c in counts.items() if c and n <= room), reverse=True)
    steps.left -= len(lengths)
    # Bit s of reach[i]: some pieces of lengths[i:] add up to s.
    reach, sums = [1] * (len(lengths) + 1), (1 << room + 1) - 1
    for i in range(len(lengths) - 1, -1, -1):
        mask, left, each = reach[i + 1], min(counts[lengths[i]], room // lengths[i]), 1
        while left:
            each = min(each, left)
            mask |= mask << each * lengths[i] & sums
            left, each = left - each, 2 * each
        reach[i] = mask
    descending = [-n for n in lengths]
    for waste in range(min(room, most_waste) + 1):
        if not reach[0] >> room - waste & 1:
            continue
        # (next length, sum still wanted, shortest length passed that has a piece left, chosen)
        stack: list[tuple[int, int, float, Filling]] = [(0, room - waste, float("inf"), ())]
        while stack:
            steps.left -= 1
            if steps.left < 0:
                return
            i, rest, free, chosen = stack.pop()
            if not rest:
                if i == len(lengths) or lengths[-1] > waste:
                    yield chosen
                continue
            longer = bisect_left(descending, -rest, i)
            if longer > i:
                i, free = longer, lengths[longer - 1]
            if not reach[i] >> rest & 1:
                continue
            length = lengths[i]
            most = min(counts[length], rest // length) if free - length > waste else 0
            for times in range(most + 1):  # the largest number is tried first
                whole = times == counts[length]
                if (whole or length > waste) and reach[i + 1] >> rest - times * length & 1:
                    more = (*chosen, (length, times)) if times else chosen
                    stack.append((i + 1, rest - times * length, free if whole else length, more))


def complete_bins(counts: dict[int, int], capacity: int, steps: int | Steps = MAX_STEPS) -> list[tuple[Filling, int]]:
    """Fillings and how often each is used, in as few bins as found.

    Every level of the search fills a bin around the longest piece left, as often as it can or once; at some levels best
    fit packs the rest, and the best such solution is kept. A branch ends where the waste so far admits no better one.
    Stops when the lower bound is met, when all is searched, or after so many ``steps``, which count every length that any
    part of the search looks at; the best solution so far always holds every piece.
    """
    steps = steps if isinstance(steps, Steps) else Steps(steps)
    counts = {n: c for n, c in counts.items() if c}
    best = best_fit(counts, capacity)
    least, total = lower_bound(counts, capacity), sum(n * c for n, c in counts.items())
    size = sum(m for _, m in best)
    left, path = dict(counts), []
    bins = waste = nodes = 0

    def spare() -> int:
        """What may still be wasted in a solution better than the best."""
        return (size - 1) * capacity - total - waste

    def children() -> Iterator[tuple[Filling, int]]:
        longest = max(n for n, c in left.items() if c)
        beside = {n: c - (n == longest) for n, c in left.items()}
        for filling in fillings(beside, capacity - longest, spare(), steps):
            merged = dict(filling)
            merged[longest] = merged.get(longest, 0) + 1
            whole = tuple(sorted(merged.items(), reverse=True))
            most = min(left[n] // t for n, t in whole)
            yield whole, most
            if most > 1:
                yield whole, 1

    def apply(filling: Filling, times: int) -> None:
        for n, t in filling:
            left[n] -= t * times

    # An open level holds its fillings and how many were taken. Those far above are closed, as each holds the sums of all its
    # lengths, and opened again if the search comes back to them.
    stack = [[children(), 0]] if counts and size > least else []
    while stack and size > least and steps.left > 0:
        level = stack[-1]
        if level[0] is None:
            level[0] = islice(children(), level[1], None)
        step = next(level[0], None)
        level[1] += 1
        if step is None:
            stack.pop()
            if path:
                filling, times, lost = path.pop()
                apply(filling, -times)
                bins, waste = bins - times, waste - lost
            continue
        filling, times = step
        lost = times * (capacity - sum(n * t for n, t in filling))
        if lost > spare():
            continue
        apply(filling, times)
        bins, waste = bins + times, waste + lost
        path.append((filling, times, lost))
        nodes += 1
        if nodes % COMPLETE_EVERY == 1 or not any(left.values()):
            rest = best_fit(left, capacity)
            steps.left -= len(left) + len(rest)
            if bins + sum(t for _, t in rest) < size:
                best = [(f, t) for f, t, _ in path] + rest
                size = bins + sum(t for _, t in rest)
        # Where all is placed there is nothing to fill: the level ends at once and is taken back.
        stack.append([children() if any(left.values()) else iter(()), 0])
        if len(stack) > OPEN_LEVELS:
            stack[-OPEN_LEVELS - 1][0] = None
    return best


def _places(plan: list[tuple[Filling, int]]) -> pd.DataFrame:
    """For each length, consecutive ranks and the bins and offsets that take them."""
    rows, ranks, sequence = [], {}, 0
    for filling, times in plan:
        offset = 0
        for length, each in filling:
            first = ranks.get(length, 0)
            rows.append((length, first, each, sequence, offset))
            ranks[length] = first + each * times
            offset += each * length
        sequence += times
    return pd.DataFrame(rows, columns=["length", "first", "each", "sequence", "offset"]).sort_values(["length", "first"])


_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, nth bigint"


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, path: str | None = None,
    end_id: int = 0, max_steps: int = MAX_STEPS,
) -> DataFrame:
    """Place every document in sequences of at most ``capacity`` tokens, one row per piece:
    ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A document is its text's ids and ``end_id``; a null text counts as empty. Only documents longer than
    ``capacity`` are cut, into pieces of ``capacity`` and one that may be shorter. Rows with one identifier are
    packed as rows of their own. An empty table gives no rows. Runs jobs when called: the pieces are written
    once, and their lengths are counted, at most ``capacity`` numbers.
    """
    path = path or vocabulary_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = WordEncoder(path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        end = int(end_id).to_bytes(4, "little")
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in portions(texts):
                out = []
                for doc_id, ids in zip(doc_ids[a:b], encoder.encode(texts[a:b])):
                    ids += end
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        raw = ids[at:at + 4 * capacity]
                        n = len(raw) // 4
                        out.append((doc_id, piece, at // 4, n, zlib.crc32(raw), part, seen[n]))
                        seen[n] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    names = [c.split()[0] for c in _PIECES.split(", ")]
    types = [pa.int32() if c.endswith(" int") else pa.int64() for c in _PIECES.split(", ")]
    rows = narrowed(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    pieces = written(rows.mapInArrow(cut, _PIECES), "pieces")
    by_part = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = _places(complete_bins(counts, capacity, max_steps))
    # Ranks of a length are dealt out to tasks in order; one row per task and length is shuffled.
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranked = pieces.join(
        by_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before")), ["length", "part"]
    ).withColumn("rank", F.col("_before") + F.col("nth"))
    span = max(counts.values(), default=0) + 1
    keys = (plan["length"] * span + plan["first"]).to_numpy(np.int64)
    each, sequence, offset, first = (plan[c].to_numpy(np.int64) for c in ("each", "sequence", "offset", "first"))

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(keys, length.to_numpy() * span + rank.to_numpy(), "right") - 1
        nth = rank.to_numpy() - first[at]
        return pd.DataFrame(
            {"sequence_id": sequence[at] + nth // each[at], "offset": offset[at] + nth % each[at] * length.to_numpy()}
        )

    return ranked.withColumn("_place", place("length", "rank")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "_place.sequence_id", "_place.offset"
    )
