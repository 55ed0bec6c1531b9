"""Nearest neighbours by collision counting over single projections.

Every vector is projected on many random lines and each line keeps its vectors sorted by projection. A
query opens a window around its own projection on every line and counts, for each vector, the windows
that hold it. Windows are widened step by step (virtual rehashing: the same sorted arrays serve every
width, only what a step adds is counted) until enough vectors have collided on half of the lines; these
are verified with their exact cosine.

Queries and vectors meet in blocks of bounded size, so no task grows with the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from sightline.llm.common import narrowed

# Lines, share of them on which a candidate must collide, first half-width of a window and its growth per step.
LINES, COLLIDE, WIDTH, GROWTH, STEPS = 128, 0.5, 0.6, 1.06, 30
# A step is the last if this share of the block, and this many vectors at least, have enough collisions.
VERIFY_SHARE, VERIFY_LEAST = 0.25, 1000
# More than any two orders of summing a cosine differ by.
ROUNDING = 1e-9
VECTORS_PER_BLOCK, QUERIES_PER_BLOCK = 8192, 256


class CollisionIndex:
    """Sorted projections of a block of unit vectors, (vectors, dimension)."""

    def __init__(self, vectors: np.ndarray, lines: int = LINES, seed: int = 11):
        self.lines = np.random.default_rng(seed).normal(size=(vectors.shape[1], lines))
        projected = (vectors @ self.lines).T
        self.order = np.argsort(projected, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(projected, self.order, axis=1)

    def candidates(self, queries: np.ndarray, enough: int) -> Iterator[np.ndarray]:
        """For each unit vector of ``queries``: the vectors that collide with it on enough lines, in the first window
        width at which there are ``enough`` of them; all vectors if no width has.
        """
        m, n = self.order.shape
        if n <= enough:
            yield from (np.arange(n) for _ in queries)
            return
        widths = WIDTH * GROWTH ** np.arange(STEPS)
        at = queries @ self.lines
        # Where every window of every query begins and ends on each line.
        low, high = np.empty((2, len(queries), STEPS, m), np.int64)
        for line, row in enumerate(self.sorted):
            low[:, :, line] = np.searchsorted(row, at[:, line, None] - widths)
            high[:, :, line] = np.searchsorted(row, at[:, line, None] + widths, "right")
        least = COLLIDE * m
        for own_low, own_high in zip(low.tolist(), high.tolist()):
            counts = np.zeros(n, np.int64)
            left = right = None
            for new_left, new_right in zip(own_low, own_high):
                if left is None:
                    parts = [row[a:b] for row, a, b in zip(self.order, new_left, new_right)]
                else:  # only what the windows have gained
                    parts = [row[a:b] for row, a, b in zip(self.order, new_left, left) if a < b]
                    parts += [row[a:b] for row, a, b in zip(self.order, right, new_right) if a < b]
                left, right = new_left, new_right
                if parts:
                    counts += np.bincount(np.concatenate(parts), minlength=n)
                found = np.flatnonzero(counts >= least)
                if len(found) >= enough:
                    break
            else:
                found = np.arange(n)
            yield found


def _unit(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norms = np.sqrt((vectors * vectors).sum(axis=1))
    return vectors / norms[:, None], norms


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector, dims) of the rows whose vectors have a direction: not null, empty, zero, nor holding a null, NaN or infinity."""
    finite = F.forall(
        "vector", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    )
    return narrowed(df, id=id_col, vector=vector_col).select(
        F.col("id").cast("bigint").alias("id"), F.col("vector"), F.size("vector").alias("dims")
    ).where(
        F.col("id").isNotNull() & F.col("vector").isNotNull() & F.coalesce(finite, F.lit(False))
        & F.exists("vector", lambda x: x != 0)
    )


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
    vectors_per_block: int = VECTORS_PER_BLOCK, queries_per_block: int = QUERIES_PER_BLOCK, seed: int = 11,
) -> DataFrame:
    """The ``k`` vectors found nearest to each query by cosine: ``query_id, rank, vec_id, score``.

    Both tables have ``id_col`` and ``vector_col``; a vector is no neighbour of the query with its own identifier.
    Scores are exact, in double precision; ties go to the smaller identifier; fewer rows come back if there are
    fewer candidates. Vectors without a direction take no part, and vectors of different dimension do not meet. A
    block that is small is searched whole. Runs a job when called, to count both tables.
    """
    base, asked = usable(vectors, id_col, vector_col), usable(queries, id_col, vector_col)
    blocks = max(1, -(-base.count() // vectors_per_block))
    parts = max(1, -(-asked.count() // queries_per_block))

    def block(n: int, salt: int):
        return F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(n)).cast("int")

    everywhere = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = base.withColumn("block", block(blocks, 1)).withColumn("part", everywhere(parts))
    right = asked.withColumn("part", block(parts, 2)).withColumn("block", everywhere(blocks))

    def search(own: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(own) and len(asking):
            own = own.sort_values("id", kind="stable")
            raw, ids = np.stack(own["vector"].to_numpy()).astype(np.float64), own["id"].to_numpy()
            units, norms = _unit(raw)
            index = CollisionIndex(units, seed=seed)
            enough = max(VERIFY_LEAST, k + 1, int(VERIFY_SHARE * len(own)))
            asked_raw = np.stack(asking["vector"].to_numpy()).astype(np.float64)
            asked_units, asked_norms = _unit(asked_raw)
            met = index.candidates(asked_units, enough)
            for query, vector, unit, norm, found in zip(asking["id"].to_numpy(), asked_raw, asked_units, asked_norms, met):
                found = found[ids[found] != query]
                rough = units[found] @ unit
                if len(found) > k:  # whatever rounding may put among the first k
                    found = found[rough >= np.partition(rough, -k)[-k] - ROUNDING]
                scores = (raw[found] * vector).sum(axis=1) / (norms[found] * norm)
                best = np.lexsort((ids[found], -scores))[:k]
                out += zip([query] * len(best), ids[found][best].tolist(), scores[best].tolist())
        columns = {"query_id": "int64", "vec_id": "int64", "score": "float64"}
        return pd.DataFrame(out, columns=list(columns)).astype(columns)

    keys = ["dims", "block", "part"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        search, "query_id bigint, vec_id bigint, score double"
    )
    # Some k rows per block and query are left.
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
