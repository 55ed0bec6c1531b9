"""Population multipliers: how many people one seen device stands for."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sightline.functions.cells import cell_child, cell_parent
from sightline.functions.scalars import between_dates, div0
from sightline.functions.timebins import HOUR_S, anchored_bin, hour_bin, utc_date
from sightline.operators.storage import sized

# Resolution codes, bin widths and the cap of a combined multiplier.
FINE, COARSE, MARKET = 7, 5, 100
WIDTH_S = {FINE: HOUR_S, COARSE: 4 * HOUR_S, MARKET: 24 * HOUR_S}
MAX_MULTIPLIER = 1000
STORED = "decimal(20,4)"

BASE_KEYS = ("resolution", "cell", "bin_start")
MULTIPLIER_KEYS = ("core_date", "cell", "bin_start")


def _epoch(day: dt.date) -> int:
    return int(dt.datetime(day.year, day.month, day.day, tzinfo=dt.timezone.utc).timestamp())


def market_lookup(pings: DataFrame, dma_map: DataFrame, market_info: DataFrame) -> DataFrame:
    """Add market_id through dma code -> market hash -> market; NULL where there is none.

    A few hundred codes meet every ping: the two lists are joined first and broadcast if they fit, as a
    shuffle by code would gather a market in a task.
    """
    markets = market_info.select("markethash", F.col("marketid").alias("market_id"))
    codes = dma_map.select("dma_code", "markethash").join(markets, "markethash", "left")
    return pings.drop("market_id").join(sized(codes), "dma_code", "left")


def base_multiplier(
    pings: DataFrame, population: DataFrame, dma_map: DataFrame, market_info: DataFrame, start: dt.date, end: dt.date
) -> DataFrame:
    """People per seen device for each fine cell-hour, coarse cell-4h and market-day.

    One scan feeds the three levels: each ping becomes one (resolution, area, bin) row
    per level and the distinct devices are counted once, deduplicated map-side first.
    """
    anchor = _epoch(start)
    located = market_lookup(pings.where(between_dates("core_date", start, end)), dma_map, market_info)

    def level(resolution: int, area: str) -> Column:
        return F.struct(
            F.lit(resolution).alias("resolution"),
            F.col(area).cast("bigint").alias("cell"),
            anchored_bin(F.col("unix_ts"), anchor, WIDTH_S[resolution]).alias("bin_start"),
        )

    seen = (
        located.select(
            "device_hash",
            F.explode(F.array(level(FINE, "c14"), level(COARSE, "c11"), level(MARKET, "market_id"))).alias("at"),
        )
        .select("device_hash", "at.*")
        .where((F.col("resolution") != MARKET) | F.col("cell").isNotNull())
        .groupBy(*BASE_KEYS)
        .agg(F.countDistinct("device_hash").alias("devices"))
    )
    people = population.select(F.col("cell"), F.lit(False).alias("is_market"), F.col("pop").cast("double")).unionByName(
        market_info.select(
            F.col("marketid").cast("bigint").alias("cell"),
            F.lit(True).alias("is_market"),
            F.get_json_object("marketmetrics", "$.marketpop").cast("double").alias("pop"),
        )
    )
    return (
        seen.withColumn("is_market", F.col("resolution") == MARKET)
        .join(people, ["cell", "is_market"], "left")
        .select(
            utc_date(F.col("bin_start")).alias("core_date"),
            *BASE_KEYS,
            F.greatest(F.coalesce(div0(F.col("pop"), F.col("devices")), F.lit(1.0)), F.lit(1.0))
            .cast(STORED)
            .alias("multiplier"),
        )
    )


def rollup_multiplier(base: DataFrame, cell_market: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Mean of the fine, coarse and market multipliers for each fine cell-hour, capped.

    The coarse and market bins that hold an hour are computed from it, so the containment
    join is a plain equi join. Bins are counted from midnight of ``start``, as when built.
    """
    anchor = _epoch(start)
    base = base.where(between_dates("core_date", start, end))

    def level(resolution: int, cell: str, bin_start: str, value: str) -> DataFrame:
        rows = base.where(F.col("resolution") == resolution)
        return rows.select(F.col("cell").alias(cell), F.col("bin_start").alias(bin_start), F.col("multiplier").alias(value))

    fine = (
        base.where(F.col("resolution") == FINE)
        .withColumn("coarse_cell", cell_parent(F.col("cell"), 11))
        .withColumn("coarse_bin", anchored_bin(F.col("bin_start"), anchor, WIDTH_S[COARSE]))
        .withColumn("market_bin", anchored_bin(F.col("bin_start"), anchor, WIDTH_S[MARKET]))
        .withColumn("first_child", cell_child(F.col("cell"), 17, 0))
    )
    joined = (
        fine.join(level(COARSE, "coarse_cell", "coarse_bin", "m_coarse"), ["coarse_cell", "coarse_bin"], "left")
        .join(cell_market.select(F.col("cell").alias("first_child"), "market_id"), "first_child", "left")
        .join(level(MARKET, "market_id", "market_bin", "m_market"), ["market_id", "market_bin"], "left")
    )
    parts = [F.col(c).cast("double") for c in ("multiplier", "m_coarse", "m_market")]
    total = sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0))
    present = sum((p.isNotNull().cast("int") for p in parts), F.lit(0))
    return joined.select(
        "core_date",
        "cell",
        "bin_start",
        (F.col("bin_start") + WIDTH_S[FINE] - 1).alias("bin_end"),
        hour_bin(F.col("bin_start")).alias("time_bin_1h"),
        F.least(total / present, F.lit(float(MAX_MULTIPLIER))).cast(STORED).alias("multiplier"),
    )


def apply_multiplier(exposures: DataFrame, multiplier: DataFrame) -> DataFrame:
    """Add ``multiplier`` (NULL on a miss) and ``mp_value``, the weighted exposure (1 on a miss)."""
    m = multiplier.select("core_date", "time_bin_1h", "c14", F.col("multiplier").cast("double").alias("multiplier"))
    return exposures.join(m, ["core_date", "time_bin_1h", "c14"], "left").withColumn(
        "mp_value", F.coalesce(F.col("multiplier"), F.lit(1.0)) * F.col("decayed_value")
    )


def weighted_totals(exposures: DataFrame, multiplier: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Exposures per (keys, day, hour, cell) with their count and summed weighted value.

    All rows of one cell-hour share a multiplier, so they are summed before the join:
    the shuffle carries one row per combination instead of one per exposure, and a
    crowded cell-hour shrinks on the map side.
    """
    at = ["core_date", "time_bin_1h", "c14"]
    summed = exposures.groupBy(*dict.fromkeys([*keys, *at])).agg(
        F.sum("decayed_value").alias("decayed_value"), F.count(F.lit(1)).alias("exposures")
    )
    return apply_multiplier(summed, multiplier)


def backfill_market_id(pings: DataFrame, cell_market: DataFrame) -> DataFrame:
    """Set market_id from the fine cell's market; keep the old one where the cell is unmapped."""
    m = cell_market.select(F.col("cell").alias("c17"), F.col("market_id").alias("_mapped"))
    old = F.col("market_id") if "market_id" in pings.columns else F.lit(None).cast("bigint")
    return pings.join(m, "c17", "left").withColumn("market_id", F.coalesce("_mapped", old)).drop("_mapped")
