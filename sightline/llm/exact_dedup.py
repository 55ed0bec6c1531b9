"""Exact duplicates by a distributed content sort.

Normalised texts are range-partitioned by sampled splitters and sorted inside each partition, so
that equal texts lie next to each other; every row is then compared in full with its neighbour.
The sort key is the first bytes of the text, its digest, the text and the identifier: splitters
stay small whatever the text, and a text that fills a third of the table is cut into ranges of
identifiers and spread over many tasks. Runs that cross a partition border are joined up from one
row per border.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from sightline.llm.common import narrowed, written

# Characters of the text that lead the sort key; ties go by digest.
KEY_CHARS = 32
# What stands for no identifier while the smallest, or the largest, of a group is looked for.
NONE = {"smallest": (1 << 63) - 1, "largest": -(1 << 63)}

_RUNS = pa.schema([
    ("doc_id", pa.int64()), ("sha", pa.binary()), ("size", pa.int64()), ("low", pa.int64()), ("high", pa.int64()),
    ("part", pa.int32()), ("first", pa.bool_()), ("last", pa.bool_()), ("edge", pa.string()),
])
_RUNS_DDL = (
    "doc_id bigint, sha binary, size bigint, low bigint, high bigint, part int, first boolean, last boolean, edge string"
)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Give each row of a sorted partition the size and extremes of its run of equal neighbours.

    The open run is held as identifiers and one text. Runs that touch a border of the partition are
    marked, and their first row carries the text.
    """
    part = TaskContext.get().partitionId()
    held_ids, held_sha, text, first = [], [], None, True

    def rows(ids, sha, opens, first, last, edges):
        sizes = np.diff(np.append(opens, len(ids)))
        columns = [
            ids, sha, np.repeat(sizes, sizes), np.repeat(np.minimum.reduceat(ids, opens), sizes),
            np.repeat(np.maximum.reduceat(ids, opens), sizes), np.full(len(ids), part, np.int32), first, last, edges,
        ]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _RUNS.types)], schema=_RUNS)

    def run_of_border(last: bool) -> pa.RecordBatch:
        ids, sha = np.concatenate(held_ids), [x for piece in held_sha for x in piece]
        return rows(ids, sha, np.array([0]), [first] * len(ids), [last] * len(ids), [text] + [None] * (len(ids) - 1))

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ids, sha, texts = batch.column("doc_id").to_numpy(), batch.column("sha").to_pylist(), batch.column("norm")
        begins = np.empty(n, bool)
        begins[0] = text is None or texts[0].as_py() != text
        begins[1:] = pc.not_equal(texts.slice(1), texts.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        opens = np.flatnonzero(begins)
        if len(opens) and text is not None:
            held_ids.append(ids[: opens[0]])
            held_sha.append(sha[: opens[0]])
            if first:
                yield run_of_border(False)
            else:
                before = np.concatenate(held_ids)
                flat = [x for piece in held_sha for x in piece]
                yield rows(before, flat, np.array([0]), *[[False] * len(before)] * 2, [None] * len(before))
            first = False
        elif not len(opens):
            held_ids.append(ids)
            held_sha.append(sha)
            continue
        if text is None and len(opens) > 1:  # the partition's first run ends in its first batch
            held_ids, held_sha, text = [ids[: opens[1]]], [sha[: opens[1]]], texts[0].as_py()
            yield run_of_border(False)
            first, opens = False, opens[1:]
        at, end = opens[0], opens[-1]
        if end > at:
            yield rows(ids[at:end], sha[at:end], opens[:-1] - at, *[[False] * (end - at)] * 2, [None] * (end - at))
        held_ids, held_sha, text = [ids[end:]], [sha[end:]], texts[int(end)].as_py()
    if text is not None:
        yield run_of_border(True)


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise: Callable[[Column], Column] | None = None,
    keep: str = "smallest",
) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when their normalised forms are identical (``normalise`` maps a string column;
    none by default); a null text counts as empty. ``keep`` is ``smallest`` or ``largest``: the
    identifier that stays of a group. Repeated rows count each in the group's size, and all of them are kept if
    their identifier is. A row without an identifier counts in its group's size and stays only if no row of the group has one,
    as do all such rows then, with a null ``keep_id``; the one identifier that is last in the order (2**63 - 1 for ``smallest``, -2**63 for
    ``largest``) is read as none. An empty table gives no rows; other columns of ``docs`` are ignored. Runs a job when called.
    """
    if keep not in NONE:
        raise ValueError("keep is 'smallest' or 'largest'")
    norm = F.coalesce(F.col("norm"), F.lit(""))
    rows = (
        narrowed(docs, doc_id=id_col, norm=text_col)
        .withColumn("doc_id", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NONE[keep])))
        .withColumn("norm", normalise(norm) if normalise else norm)
        .withColumn("sha", F.unhex(F.sha2(F.col("norm").cast("binary"), 256)))
        .withColumn("head", F.substring("norm", 1, KEY_CHARS))
    )
    ordered = rows.repartitionByRange("head", "sha", "doc_id").sortWithinPartitions("head", "sha", "norm", "doc_id")
    runs = written(ordered.select("doc_id", "norm", "sha").mapInArrow(_runs, _RUNS_DDL), "exact-runs")

    # A run goes on in the next partition that has rows if that one begins with the same text.
    edges = runs.where("edge is not null").select("part", "first", "last", "size", "low", "high", "edge")
    parts = edges.select("part").distinct().withColumn("_next", F.lead("part").over(Window.orderBy("part")))
    goes_on = (
        edges.where("last").select("part", F.col("edge").alias("_end"))
        .join(parts, "part")
        .join(edges.where("first").select(F.col("part").alias("_next"), F.col("edge").alias("_begin")), "_next")
        .where("_end = _begin").select(F.col("_next").alias("part"), F.lit(True).alias("first"), F.lit(0).alias("_opens"))
    )
    chain = Window.orderBy("part", F.desc("first"))
    border = (
        edges.drop("edge").join(goes_on, ["part", "first"], "left")
        .withColumn("_chain", F.sum(F.coalesce("_opens", F.lit(1))).over(chain))
    )
    whole = border.groupBy("_chain").agg(
        F.sum("size").alias("_size"), F.min("low").alias("_low"), F.max("high").alias("_high")
    )
    # Two rows a partition at most, whatever the table holds: small enough to broadcast.
    border = border.select("part", "first", "_chain").join(whole, "_chain").drop("_chain")
    keep_id = F.coalesce("_low" if keep == "smallest" else "_high", "low" if keep == "smallest" else "high")
    named = lambda identifier: F.nullif(identifier, F.lit(NONE[keep]))
    at_border = (F.col("first") | F.col("last")) & (F.col("part") == F.col("_part")) & (F.col("first") == F.col("_first"))
    return (
        runs.join(F.broadcast(border.withColumnsRenamed({"part": "_part", "first": "_first"})), at_border, "left")
        .select(
            named(F.col("doc_id")).alias("doc_id"), named(keep_id).alias("keep_id"), F.coalesce("_size", "size").alias("group_size"),
            (F.col("doc_id") == keep_id).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
        )
    )
