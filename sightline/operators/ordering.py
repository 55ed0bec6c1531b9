"""Order-dependent rules that never put a whole key into one task.

A window over (device, frame) sorts everything that key holds in a single task.
These forms cut each key into time slices first, so a key with a third of all
rows is spread over its slices and the per-key step only sees one row per slice.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from sightline.operators.storage import kept

# Value ranges of a small table, and rows that a range holds of a large one.
RANGE_SPLITS, ROWS_PER_RANGE = 127, 5_000_000
# Sample sizes up to which every task may send a whole sample.
DIRECT_SAMPLE = 1000


def first_of_island(
    df: DataFrame, keys: Sequence[str], ts: str, gap_s: int, tiebreak: Sequence[str] = (), slice_column: str | None = None
) -> DataFrame:
    """Keep the first row of every run whose steps are all shorter than ``gap_s``.

    A row opens a run when its predecessor is at least ``gap_s`` older. Two rows of
    one ``gap_s``-wide slice are closer than that, so only the first row of a slice
    can open a run, and the age of its predecessor is known from the latest time of
    the slice before. The slice step is a map-side combining aggregate; the window
    that follows holds at most one row per slice of a key. ``slice_column`` names a column that
    already holds the slice number, so that rows shuffled by it are not shuffled again.
    """
    slices = (
        df.withColumn("_slice", F.col(slice_column) if slice_column else F.floor(F.col(ts) / gap_s))
        .groupBy(*keys, "_slice")
        .agg(
            F.min_by(F.struct(*[F.col(c) for c in df.columns]), F.struct(ts, *tiebreak)).alias("_head"),
            F.max(ts).alias("_last"),
        )
    )
    before = F.lag("_last").over(Window.partitionBy(*keys).orderBy("_slice"))
    opened = slices.withColumn("_before", before).where(
        F.col("_before").isNull() | (F.col(f"_head.{ts}") - F.col("_before") >= gap_s)
    )
    return opened.select(*[F.col(f"_head.{c}").alias(c) for c in df.columns])


def previous_row(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    carry: Sequence[str],
    tiebreak: Sequence[str] = (),
    slice_s: int = 3600,
) -> DataFrame:
    """Add ``prev_<column>`` for each carried column: its value on the key's previous row.

    Rows are ordered inside (key, time slice); the last row of each slice is handed
    to the next slice of the key that has rows. The shuffle by (key, slice) is asked for:
    a plan already partitioned by the key alone would satisfy the window and leave a hot
    key whole, and would trust the union of two shuffles to be aligned.
    """
    order = [ts, *tiebreak]
    sliced = df.withColumn("_slice", F.floor(F.col(ts) / slice_s))
    tails = sliced.groupBy(*keys, "_slice").agg(
        F.max(F.struct(*order, *[F.col(c).alias(f"_carry_{c}") for c in carry])).alias("_tail")
    )
    handed = (
        tails.withColumn("_tail", F.lag("_tail").over(Window.partitionBy(*keys).orderBy("_slice")))
        .where(F.col("_tail").isNotNull())
        .select(
            *keys,
            "_slice",
            F.lit(False).alias("_own"),
            *[F.col(f"_tail._carry_{c}").alias(f"_carry_{c}") for c in carry],
        )
    )
    own = sliced.withColumn("_own", F.lit(True)).withColumns({f"_carry_{c}": F.col(c) for c in carry})
    w = Window.partitionBy(*keys, "_slice").orderBy("_own", *order)
    return (
        own.unionByName(handed, allowMissingColumns=True)
        .repartition(*keys, "_slice")
        .withColumns({f"prev_{c}": F.lag(f"_carry_{c}").over(w) for c in carry})
        .where("_own")
        .drop("_slice", "_own", *[f"_carry_{c}" for c in carry])
    )


def _with_range_bucket(df: DataFrame, value: str, spread: Sequence[str]) -> DataFrame:
    """Number the rows' value ranges; the cut points are the values whose hashes fall under a share.

    That makes the cuts a fixed sample of about a value for every ROWS_PER_RANGE rows, some RANGE_SPLITS at
    least, so the ranges hold similar numbers of rows whatever the distribution, and as many more ranges as
    there are more rows. A row's range is found in two steps, among every k-th cut and then between two of
    them. ``df`` is read three times.
    """
    rows = df.count()
    n = max(RANGE_SPLITS, rows // ROWS_PER_RANGE)
    step = math.isqrt(n) + 1
    drawn = F.pmod(F.xxhash64(*spread), F.lit(1 << 30)) < int((1 << 30) * min(1.0, n / max(1, rows)))
    # Both lists of cuts are made once, in the subquery, not in every row.
    cuts = df.where(drawn).agg(F.array_sort(F.collect_list(value)).alias("every"))
    cuts = cuts.select(F.struct("every", F.filter("every", lambda _, i: i % step == step - 1).alias("coarse")))

    def below(cut_points: Column) -> Column:
        return F.size(F.filter(cut_points, lambda c: c < F.col(value)))

    return (
        df.withColumn("_cuts", cuts.scalar())
        .withColumn("_block", below(F.col("_cuts.coarse")) * step)
        .withColumn("_bucket", F.col("_block") + below(F.slice("_cuts.every", F.col("_block") + 1, step)))
        .drop("_cuts", "_block")
    )


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join on ``keys`` in which NULL meets NULL; the left side's key columns are kept."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    return left.join(renamed, on, how).drop(*[f"_right_{k}" for k in keys])


def exact_percentiles(
    df: DataFrame, groups: Sequence[str], value: str, named: dict[str, float], weight: str | None = None
) -> DataFrame:
    """Interpolated percentiles per group, exact, with no group gathered in one task.

    Equal values are counted first (map-side) and the counts checkpointed, as they are read
    several times: to cut the values into ranges, to add up the ranges, and to count inside
    them. ``weight`` counts a row that many times. Runs a job when called.
    """
    n = F.sum(weight) if weight else F.count(F.lit(1))
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*[F.col(g) for g in groups], F.col(value).cast("double").alias("_v"))
        .agg(n.alias("_n"))
        .withColumn("_all", F.lit(1))
    )
    keys = list(groups) or ["_all"]
    counts = _with_range_bucket(kept(counts), "_v", [*groups, "_v"])
    per_bucket = counts.groupBy(*keys, "_bucket").agg(F.sum("_n").alias("_in_bucket"))
    in_order = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(
        *keys,
        "_bucket",
        F.coalesce(F.sum("_in_bucket").over(in_order), F.lit(0)).alias("_offset"),
        F.sum("_in_bucket").over(Window.partitionBy(*keys)).alias("_total"),
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = (
        join_null_safe(counts, offsets, [*keys, "_bucket"])
        .withColumn("_upto", F.col("_offset") + F.sum("_n").over(inside))
    )

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_upto") - F.col("_n") <= rank) & (rank < F.col("_upto")), F.col("_v")))

    ends, out = [], []
    for name, p in named.items():
        position = F.lit(float(p)) * (F.col("_total") - 1)
        ends += [
            at(F.floor(position)).alias(f"_lo_{name}"),
            at(F.ceil(position)).alias(f"_hi_{name}"),
            F.max(position - F.floor(position)).alias(f"_f_{name}"),
        ]
        lo, hi, f = (F.col(f"_{part}_{name}") for part in ("lo", "hi", "f"))
        out.append((lo + (hi - lo) * f).alias(name))
    return ranked.groupBy(*keys).agg(*ends).select(*groups, *out)


def beside(*one_row: DataFrame) -> DataFrame:
    """One row with the columns of several one-row frames, without a join."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), one_row)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def first_n_by(df: DataFrame, column: str, n: DataFrame) -> DataFrame:
    """The first ``n`` rows in the order of a unique ``column``; ``n`` is a one-cell DataFrame.

    The value of the n-th row is found: the sizes of value ranges tell the range it lies in, and only that one is
    ordered. The rows up to it are then a filter. Rows without a value come last and are never among the first.
    Runs a job when called, as the rows are checkpointed before they are read several times.
    """
    rows = kept(df.where(F.col(column).isNotNull()))
    bucketed = _with_range_bucket(rows, column, [column])
    sizes = bucketed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_size"))
    upto = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    ends = sizes.select("_bucket", "_size", F.sum("_size").over(upto).alias("_end")).withColumn("_wanted", n.scalar())
    # The range that holds the n-th row; the last one if there are fewer rows.
    last = ends.where("_end - _size < _wanted").agg(
        F.max_by(F.struct("_bucket", (F.col("_wanted") - F.col("_end") + F.col("_size")).alias("_place")), "_bucket").alias("_last")
    ).select("_last.*")
    inside = Window.partitionBy("_bucket").orderBy(column)
    threshold = (
        bucketed.join(F.broadcast(last), "_bucket").withColumn("_rank", F.row_number().over(inside))
        .where("_rank <= _place").agg(F.max(column))
    )
    return rows.where(F.col(column) <= threshold.scalar()).select(*df.columns)


def hash_sample(df: DataFrame, k: int, by: Sequence[str], seed: int = 0) -> DataFrame:
    """``k`` rows picked by a seeded hash of ``by``, the same on every run: those that sort first by it.

    A large sample would have every task send ``k`` rows to one. As hashes are spread evenly, a cut a
    little above k / rows keeps hardly more than ``k`` rows in all, and only these are sorted; should it keep fewer,
    all rows are. Runs a job when called with a large ``k``.
    """
    text = F.concat_ws(":", *[F.col(c).cast("string") for c in by], F.lit(str(seed)))
    hashed = df.withColumn("_h", F.md5(text))
    if k > DIRECT_SAMPLE:
        share = (k + 6 * k**0.5) / max(1, df.count())
        if share < 1:
            few = hashed.where(F.col("_h") < f"{int(share * 16**8):08x}")
            hashed = few if few.count() >= k else hashed
    return hashed.orderBy("_h", *by).limit(k).drop("_h")
