"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sightline.llm.common import written

MAX_ROUNDS = 60
# Links that a task contracts at once.
AT_ONCE = 1 << 19


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every identifier of some links but the smallest it reaches by them, and that one: fewer links that connect as much."""
    ids, place = np.unique(np.append(u, v), return_inverse=True)
    u, v = place[:len(u)], place[len(u):]
    label = np.arange(len(ids))
    while True:
        x, y = label[u], label[v]
        apart = x != y
        if not apart.any():
            hung = label < np.arange(len(ids))
            return ids[hung], ids[label[hung]]
        u, v, x, y = u[apart], v[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []

    def flushed() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(x) for x in stars(rows["u"].to_numpy(), rows["v"].to_numpy())], names=["u", "v"])

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= AT_ONCE:
            yield flushed()
    if held:
        yield flushed()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``id, component_id`` of every identifier in ``links``: the smallest identifier it can reach.

    Every task first contracts the links it reads, AT_ONCE at a time, so that of a group with many links each identifier
    brings one from each such run. A round then hangs every identifier's larger neighbours on its smallest one, then its smaller ones; it takes
    some log(n) rounds until only stars are left. Each round is written to the shared folder, which cuts the
    lineage. A link to itself makes a component of one.
    """
    both = links.select(F.col(a).cast("bigint").alias("u"), F.col(b).cast("bigint").alias("v"))
    alone = both.where("u = v").select("u").distinct()
    edges = written(both.where("u <> v").mapInArrow(_contracted, "u bigint, v bigint").distinct(), "links")
    state = None
    for _ in range(MAX_ROUNDS):
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = (
            around.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        own = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(own, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v"))
        )).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        edges = written(small, "links")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("id")).unionByName(alone.select(F.col("u").alias("id"))).distinct()
    hung = edges.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
    return hung.unionByName(roots.join(hung, "id", "left_anti").select("id", F.col("id").alias("component_id")))
