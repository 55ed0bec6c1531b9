"""Tables bucketed by a key, so that joins and groupings by it move no rows.

One task reads a bucket, and adaptive execution cannot split it. A key with more rows than a task should read is
therefore stored apart, as is a missing key, in a table without buckets, whose joins Spark spreads as it does any other.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from sightline.operators.storage import kept, new_path, save_table, sized

# Rows of a bucket, about, and rows of one key that make it heavy.
BUCKET_ROWS, HEAVY_ROWS = 4_000_000, 4_000_000


@dataclass(frozen=True)
class Bucketed:
    """A stored table in two parts that share no key: ``light`` is bucketed, ``heavy`` is not."""

    light: DataFrame
    heavy: DataFrame

    @property
    def whole(self) -> DataFrame:
        return self.light.unionByName(self.heavy)


def store_bucketed(
    spark: SparkSession, key: str, tables: dict[str, DataFrame], buckets: int | None = None, heavy_rows: int = HEAVY_ROWS,
) -> dict[str, Bucketed]:
    """Store ``tables`` (name to rows) bucketed and sorted by ``key``, all in the same number of buckets.

    A key that has more than ``heavy_rows`` rows in any of them is heavy in all, so that equal keys are always in like parts.
    A null key is heavy. ``buckets`` follows the largest table if not given. ``{name}_light`` is a table of the session's catalog
    over files in the shared folder, one file a bucket, replaced if it exists; other sessions find it if the catalog is a shared
    one. Runs jobs when called.
    """
    counts = {name: kept(df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))) for name, df in tables.items()}
    if buckets is None:
        rows = max([c.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0] for c in counts.values()], default=0)
        buckets = 1 << max(0, math.ceil(math.log2(max(1, rows / BUCKET_ROWS))))
    over = [c.where((F.col("_n") > heavy_rows) & F.col(key).isNotNull()).select(key) for c in counts.values()]
    heavy = sized(kept(reduce(DataFrame.unionByName, over).distinct()))
    stored = {}
    for name, df in tables.items():
        path = new_path(spark, name)
        common = df.join(heavy, key, "left_semi").unionByName(df.where(F.col(key).isNull())).select(*df.columns)
        rare = df.where(F.col(key).isNotNull()).join(heavy, key, "left_anti").select(*df.columns)
        spark.sql(f"DROP TABLE IF EXISTS `{name}_light`")
        (
            rare.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
            .option("path", f"{path}/light").saveAsTable(f"`{name}_light`")
        )
        stored[name] = Bucketed(spark.table(f"`{name}_light`"), save_table(common, f"{path}/heavy"))
    return stored


def parts(left: DataFrame | Bucketed, right: DataFrame | Bucketed) -> list[tuple[DataFrame, DataFrame]]:
    """Pairs of frames whose joins by the key, put together, are the join of both tables. Tables stored
    together meet part by part, the heavy rows of ``right`` by broadcast if they are few; otherwise there is one pair.
    """
    if isinstance(left, Bucketed) and isinstance(right, Bucketed):
        return [(left.light, right.light), (left.heavy, sized(right.heavy))]
    return [tuple(x.whole if isinstance(x, Bucketed) else x for x in (left, right))]
