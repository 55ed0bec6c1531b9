"""Impression, reach, frequency and density reports over weighted exposures."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sightline.functions.cells import curve_key
from sightline.functions.scalars import (
    METERS_TO_MILES, between_dates, equals, in_list, info_field, pct, ratio, sum_if, with_point,
)
from sightline.functions.timebins import daypart, local_hour
from sightline.operators.multiplier import apply_multiplier, weighted_totals
from sightline.operators.ordering import beside, exact_percentiles, previous_row
from sightline.operators.storage import kept, write_partitions

OTS = "OPPORTUNITY_TO_SEE"
LTS = "LIKELY_TO_SEE"
# A sketch of 2**12 registers tells a number of devices within 1.6 %, as a standard error.
SKETCH_LG_K = 12


def _scope(
    df: DataFrame, owner_id=None, start: dt.date | None = None, end: dt.date | None = None,
    exclude_markets: Sequence = (),
) -> DataFrame:
    df = df.where(equals("owner_id", owner_id) & between_dates("core_date", start, end))
    return df.where(~F.col("market_id").isin(list(exclude_markets))) if exclude_markets else df


def _impressions() -> list[Column]:
    gross = F.sum("mp_value")
    ots = sum_if(F.col("viewability") == OTS, F.col("mp_value"))
    return [
        ots.alias("impressions_ots"), gross.alias("impressions_gross"),
        ((ots + gross) / 2.0).alias("avg_ots_gross"), F.sum("exposures").alias("matched_exposures"),
    ]


def impressions_total(
    exposures: DataFrame, multiplier: DataFrame, paths: DataFrame, owner_id=None,
    start: dt.date | None = None, end: dt.date | None = None, exclude_markets: Sequence = (), n_assets: int = 614,
) -> DataFrame:
    """One row: impressions, assets, markets and rates per active day, asset and mile."""
    rows = _scope(exposures, owner_id, start, end, exclude_markets)
    totals = weighted_totals(rows, multiplier, ["asset_id", "market_id", "viewability"])
    active = (
        rows.select("asset_id", "core_date").distinct()
        .groupBy("asset_id").agg(F.count("core_date").alias("days"))
        .agg(F.avg("days"))
    )
    miles = _scope(paths, owner_id, start, end, exclude_markets).agg(F.sum("path_length") * METERS_TO_MILES)
    report = totals.agg(
        *_impressions(),
        F.countDistinct("asset_id").alias("unique_assets"),
        F.countDistinct("market_id").alias("markets"),
    ).withColumns({"avg_days_active": active.scalar(), "total_miles": miles.scalar()})
    for name, source in (("ots", "impressions_ots"), ("gross", "impressions_gross"), ("ots_gross", "avg_ots_gross")):
        per_mile = ratio(F.col(source), F.col("total_miles"))
        report = report.withColumns({
            f"{name}_per_day_per_asset": ratio(ratio(F.col(source), F.col("avg_days_active")), F.col("unique_assets")),
            f"{name}_per_mile": per_mile,
            f"{name}_per_mile_per_asset": ratio(per_mile, F.col("unique_assets")),
        })
    return report.withColumn("miles_per_asset", F.col("total_miles") / n_assets).drop("ots_gross_per_mile_per_asset")


def impressions_by_market(
    exposures: DataFrame, multiplier: DataFrame, paths: DataFrame, owner_id=None,
    start: dt.date | None = None, end: dt.date | None = None, exclude_markets: Sequence = (),
) -> DataFrame:
    """The same per market, with devices, active days, hours and miles; largest gross first."""
    rows = _scope(exposures, owner_id, start, end, exclude_markets)
    totals = (
        weighted_totals(rows, multiplier, ["asset_id", "market_id", "viewability"])
        .groupBy("market_id").agg(*_impressions(), F.countDistinct("asset_id").alias("unique_assets"))
    )
    devices = rows.groupBy("market_id").agg(F.countDistinct("device_hash").alias("unique_devices"))
    active = (
        rows.select("market_id", "asset_id", "core_date").distinct()
        .groupBy("market_id", "asset_id").agg(F.count("core_date").alias("days"))
        .groupBy("market_id").agg(F.avg("days").alias("avg_days_active"))
    )
    driven = (
        _scope(paths, owner_id, start, end, exclude_markets)
        .groupBy("market_id", "asset_id")
        .agg(
            (F.sum("path_length") * METERS_TO_MILES).alias("miles"),
            F.sum(F.col("end_time") - F.col("start_time")).alias("seconds"),
        )
        .groupBy("market_id")
        .agg(
            F.sum("miles").alias("total_miles"), F.avg("miles").alias("miles_per_asset"),
            F.count("asset_id").alias("assets_with_paths"),
            (F.sum("seconds") / 3600.0).alias("total_hours"), (F.avg("seconds") / 3600.0).alias("hours_per_asset"),
        )
    )
    report = totals.join(devices, "market_id", "left").join(active, "market_id", "left").join(driven, "market_id", "left")
    for name, source in (("ots", "impressions_ots"), ("gross", "impressions_gross"), ("ots_gross", "avg_ots_gross")):
        per_mile = ratio(F.col(source), F.col("total_miles"))
        report = report.withColumns({
            f"{name}_per_day_per_asset": ratio(ratio(F.col(source), F.col("avg_days_active")), F.col("unique_assets")),
            f"{name}_per_mile": per_mile,
            f"{name}_per_mile_per_asset": ratio(per_mile, F.col("unique_assets")),
        })
    return report.drop("ots_gross_per_mile_per_asset").orderBy(F.desc("impressions_gross"), "market_id")


def campaign_metrics(
    hourly: DataFrame, perf_hourly: DataFrame, campaigns: DataFrame, owner_id=None,
    campaign_ids: Sequence | None = None, start: dt.date | None = None, end: dt.date | None = None,
) -> DataFrame:
    """Campaign impressions, mileage and their rates per mile and per asset-day."""
    wanted = in_list("campaign_id", campaign_ids)
    whole = lambda c: F.round(c).cast("bigint")
    ots, gross = F.sum("impressions_ots"), F.sum("impressions_gross")
    sold = (
        _scope(hourly, owner_id, start, end).where(wanted)
        .groupBy("campaign_id")
        .agg(
            F.countDistinct("core_date").alias("days"),
            F.countDistinct("matchable_id").alias("unique_assets"),
            whole(ots).alias("impressions_ots"), whole(gross).alias("impressions_gross"),
            whole((ots + gross) / 2.0).alias("avg_ots_gross"),
        )
    )
    driven = (
        _scope(perf_hourly, owner_id, start, end).where(wanted)
        .groupBy("campaign_id").agg((F.sum("coverage_distance_meter") * METERS_TO_MILES).alias("total_miles"))
    )
    report = sold.join(campaigns.select("campaign_id", "campaignref"), "campaign_id", "left").join(driven, "campaign_id")
    for name in ("impressions_ots", "impressions_gross", "avg_ots_gross"):
        report = report.withColumns({
            f"{name}_per_mile": ratio(F.col(name), F.col("total_miles")),
            f"{name}_per_asset_per_day": F.col(name) / F.col("unique_assets") / F.col("days"),
        })
    return report.orderBy(F.desc("impressions_gross"), "campaign_id")


UFI_MEASURES = [
    "uniques_ots", "uniques_gross", "impressions_ots", "impressions_gross", "frequency_ots", "frequency_gross",
]


def ufi_campaign(ufi: DataFrame, owner_id=None, campaign_ids: Sequence | None = None) -> DataFrame:
    """Uniques, impressions and frequency per campaign, with thousands separators."""
    rows = ufi.where(equals("owner_id", owner_id) & in_list("campaign_id", campaign_ids))
    return rows.select("campaign_id", *[F.format_number(m, 0).alias(m) for m in UFI_MEASURES])


def ufi_adgroup(ufi: DataFrame, flights: DataFrame, owner_id=None, campaign_ids: Sequence | None = None) -> DataFrame:
    """The same per ad group, with its flight's name."""
    rows = ufi.where(equals("owner_id", owner_id) & in_list("campaign_id", campaign_ids))
    names = flights.select(F.col("flightid").alias("adgroup_id"), "flightref")
    return rows.join(names, "adgroup_id", "left").select(
        "adgroup_id", "flightref", *[F.format_number(m, 0).alias(m) for m in UFI_MEASURES]
    )


def market_population(market_info: DataFrame, market_ids: Sequence | None = None) -> DataFrame:
    rows = market_info.where(in_list("marketid", market_ids))
    return rows.select("marketid", F.get_json_object("marketmetrics", "$.marketpop").cast("double").alias("marketpop"))


def monthly_reach(
    exposures: DataFrame, multiplier: DataFrame, paths: DataFrame, owner_id=None,
    start: dt.date | None = None, end: dt.date | None = None, exclude_markets: Sequence = (),
) -> DataFrame:
    """Reach per month: each device's mean weight, summed. A missed multiplier weighs 1 outright.

    Exposures of a device in one cell-hour share their multiplier, so they are summed first.
    """
    rows = _scope(exposures, owner_id, start, end, exclude_markets)
    weight = F.when(F.col("multiplier").isNull(), F.col("exposures").cast("double")).otherwise(
        F.col("multiplier") * F.col("decayed_value")
    )
    month = F.trunc("core_date", "month").alias("month")
    reach = (
        weighted_totals(rows, multiplier, ["device_hash"])
        .groupBy(month, "device_hash")
        .agg((F.sum(weight) / F.sum("exposures")).alias("weight"))
        .groupBy("month")
        .agg(F.sum("weight").alias("monthly_reach"), F.count("device_hash").alias("unique_devices"))
    )
    driven = (
        _scope(paths, owner_id, start, end, exclude_markets)
        .groupBy(month).agg((F.sum("path_length") * METERS_TO_MILES).alias("total_miles"))
    )
    return reach.join(driven, "month", "left").orderBy("month")


def daily_reach_sketches(
    exposures: DataFrame, groups: Sequence[str] = ("market_id",), lg_k: int = SKETCH_LG_K, device: str = "device_hash",
) -> DataFrame:
    """``core_date, *groups, devices_sketch, exposures``: a mergeable sketch of each day's devices.

    A sketch has some 2**``lg_k`` bytes however many devices a day has. Stored by day (``write_reach_sketches``), one
    serves every period and every coarser group without a look at exposures; a day that is loaded again replaces its own.
    Days and groups may be null; exposures without a device count as exposures only.
    """
    return exposures.groupBy("core_date", *groups).agg(
        F.hll_sketch_agg(device, lg_k).alias("devices_sketch"), F.count(F.lit(1)).alias("exposures")
    )


def write_reach_sketches(sketches: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Store sketches dated, a folder a day; the days given replace their own, other days stay."""
    write_partitions(sketches, path, sort=[c for c in sketches.columns if c not in ("core_date", "devices_sketch")], mode=mode)


def reach_from_sketches(
    sketches: DataFrame, groups: Sequence[str | Column] = (), start: dt.date | None = None, end: dt.date | None = None,
) -> DataFrame:
    """``*groups, devices, exposures`` of a period: the daily sketches united, devices estimated.

    The estimate's relative standard error is about 1.04 / sqrt(2**lg_k), 1.6 % by default, whatever the period. ``groups``
    are columns of the sketches or expressions on them, such as the month of the day.
    """
    return sketches.where(between_dates("core_date", start, end)).groupBy(*groups).agg(
        F.hll_sketch_estimate(F.hll_union_agg("devices_sketch")).alias("devices"), F.sum("exposures").alias("exposures")
    )


def marginal_reach_from_sketches(
    base: DataFrame, added: DataFrame, start: dt.date | None = None, end: dt.date | None = None,
) -> DataFrame:
    """One row: estimated devices of a first medium, what a second adds to it, and both, from their daily sketches.

    What is added is the difference of two estimates, so its error is that of the whole.
    """
    def united(df: DataFrame) -> DataFrame:
        return df.where(between_dates("core_date", start, end)).agg(F.hll_union_agg("devices_sketch").alias("_sketch"))

    first, second = united(base), united(added)
    both = first.unionByName(second).agg(F.hll_sketch_estimate(F.hll_union_agg("_sketch")).alias("combined_devices"))
    alone = first.select(F.hll_sketch_estimate("_sketch").alias("base_devices"))
    return beside(alone, both).select(
        F.coalesce("base_devices", F.lit(0)).alias("base_devices"), F.coalesce("combined_devices", F.lit(0)).alias("combined_devices"),
        (F.coalesce("combined_devices", F.lit(0)) - F.coalesce("base_devices", F.lit(0))).alias("marginal_devices"),
    )


def marginal_reach(
    base_exposures: DataFrame, added_exposures: DataFrame, multiplier: DataFrame, market_id=None, owner_id=None,
    start: dt.date | None = None, end: dt.date | None = None,
) -> DataFrame:
    """What a second medium adds: devices and weight it reaches that the first does not.

    Both sides are summed per device before they meet.
    """
    def per_device(df: DataFrame) -> DataFrame:
        rows = df.where(equals("market_id", market_id) & between_dates("core_date", start, end))
        return (
            weighted_totals(rows, multiplier, ["device_hash"])
            .groupBy("device_hash").agg(F.sum("mp_value").alias("mp_value"))
        )

    def reach(df: DataFrame, name: str) -> DataFrame:
        return df.agg(
            F.count("device_hash").alias(f"{name}_devices"),
            F.coalesce(F.sum("mp_value"), F.lit(0.0)).alias(f"{name}_weighted_reach"),
        )

    base = per_device(base_exposures)
    added = per_device(added_exposures.where(equals("owner_id", owner_id) & F.col("device_hash").isNotNull()))
    marginal = added.join(base.select("device_hash"), "device_hash", "left_anti")
    report = beside(reach(base, "base"), reach(marginal, "marginal"))
    combined_devices = F.col("base_devices") + F.col("marginal_devices")
    combined_weight = F.col("base_weighted_reach") + F.col("marginal_weighted_reach")
    return report.withColumns({
        "combined_devices": combined_devices,
        "combined_weighted_reach": combined_weight,
        "device_lift_pct": pct(F.col("marginal_devices"), F.col("base_devices")),
        "weighted_lift_pct": pct(F.col("marginal_weighted_reach"), F.col("base_weighted_reach")),
        "marginal_device_share_pct": pct(F.col("marginal_devices"), combined_devices),
        "marginal_weighted_share_pct": pct(F.col("marginal_weighted_reach"), combined_weight),
    })


def exposure_table(
    exposures: DataFrame, multiplier: DataFrame, owner_id=None, start: dt.date | None = None,
    end: dt.date | None = None, viewability: Sequence[str] | None = (LTS, OTS),
) -> DataFrame:
    """Weighted exposures with the match details as numbers; the input of the reports below."""
    rows = _scope(exposures, owner_id, start, end).where(in_list("viewability", viewability))
    return apply_multiplier(with_point(rows), multiplier).select(
        "core_date", "path_id", "market_id", "asset_id", "device_hash", "device_time", "time_bin_1h",
        info_field(exposures, "match_info", "MATCH_DISTANCE_METER").alias("match_distance_meter"),
        info_field(exposures, "match_info", "PATH_LENGTH_METER").alias("path_length_meter"),
        "c14", "c17", "mp_value", "lat", "lon",
    )


def write_exposure_table(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Store weighted exposures by day, ordered by market and along the cells' curve, for the reports to read."""
    write_partitions(rows, path, sort=["market_id", curve_key(F.col("c17"))], mode=mode)


def _assets_per_device(exposures: DataFrame, period: Column, min_rows: int) -> DataFrame:
    seen = kept(
        exposures.groupBy("device_hash", period.alias("period"), "asset_id").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("device_hash", "period").agg(F.count("asset_id").alias("assets"), F.sum("n").alias("n"))
        .where(F.col("n") >= min_rows).select("assets")
    )
    totals = seen.agg(
        F.avg("assets").alias("avg_assets"), F.min("assets").alias("min_assets"), F.max("assets").alias("max_assets"),
        F.count(F.lit(1)).alias("device_periods"),
    )
    return beside(totals, exact_percentiles(seen, [], "assets", {"median_assets": 0.5}))


def assets_per_device_day(exposures: DataFrame, min_rows: int = 5) -> DataFrame:
    """Distinct assets a device meets in a day, over device-days with enough exposures."""
    return _assets_per_device(exposures, F.col("core_date"), min_rows)


def assets_per_device_week(exposures: DataFrame, min_rows: int = 20) -> DataFrame:
    """The same per week, weeks from Monday."""
    return _assets_per_device(exposures, F.trunc("core_date", "week"), min_rows)


def assets_per_device_month(exposures: DataFrame, min_rows: int = 60) -> DataFrame:
    """The same per month."""
    return _assets_per_device(exposures, F.trunc("core_date", "month"), min_rows)


def transition_gaps(exposures: DataFrame, min_assets: int = 10) -> DataFrame:
    """Time from one asset to the next different one, over devices that met enough assets.

    Equal times are ordered by asset. Equal gaps of a device are counted once, and those
    counts feed both the totals and the percentiles. Devices with too few assets are dropped
    from the counts, not from the exposures, whose shuffle would gather a busy device.
    Runs a job when called.
    """
    wide = (
        exposures.groupBy("device_hash").agg(F.countDistinct("asset_id").alias("assets"))
        .where(F.col("assets") >= min_assets).select("device_hash")
    )
    seen = exposures.select("device_hash", "asset_id", "device_time").where(F.col("device_hash").isNotNull())
    steps = (
        previous_row(seen, ["device_hash"], "device_time", ["asset_id", "device_time"], ["asset_id"])
        .where(F.col("asset_id") != F.col("prev_asset_id"))
        .groupBy("device_hash", (F.col("device_time") - F.col("prev_device_time")).alias("gap_s"))
        .agg(F.count(F.lit(1)).alias("n"))
        .join(wide, "device_hash", "left_semi")
    )
    steps = kept(steps)
    quartiles = exact_percentiles(steps, [], "gap_s", {"p25": 0.25, "p50": 0.5, "p75": 0.75}, weight="n")
    mean = F.sum(F.col("gap_s") * F.col("n")) / F.sum("n")
    totals = steps.agg(
        F.sum("n").alias("transitions"),
        F.countDistinct("device_hash").alias("devices"),
        mean.alias("avg_seconds"), (mean / 60.0).alias("avg_minutes"), (mean / 3600.0).alias("avg_hours"),
        (F.min("gap_s") / 60.0).alias("min_minutes"), (F.max("gap_s") / 3600.0).alias("max_hours"),
    )
    p25, p50, p75 = F.col("p25"), F.col("p50"), F.col("p75")
    return beside(totals, quartiles).withColumns({
        "median_seconds": p50, "median_minutes": p50 / 60.0, "median_hours": p50 / 3600.0,
        "p25_hours": p25 / 3600.0, "p75_hours": p75 / 3600.0,
    }).drop("p25", "p50", "p75")


def cell_density(exposures: DataFrame, market_id=None, min_rows: int = 10) -> DataFrame:
    """Per fine cell: exposures, devices, assets, days, dayparts, impressions; sparse cells dropped.

    Each exposure becomes one row for its device, one for its asset and one for its day; those
    collapse map-side to one row per (cell, kind, id), and counting them gives every distinct
    count in one pass. The sums ride on the device rows. The point shown is the southernmost.
    """
    part = daypart(local_hour(F.col("device_time")), morning_from=6, afternoon_from=12)
    parts = ("morning", "afternoon", "evening")

    def entry(kind: str, column: str) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.col(column).cast("string").alias("id"))

    def own(value: Column | str) -> Column:
        return F.when(F.col("kind") == "device", F.col(value) if isinstance(value, str) else value)

    ids = (
        exposures.where(equals("market_id", market_id) & F.col("c17").isNotNull())
        .select(
            "c17", "mp_value", "match_distance_meter", "lat", "lon", "core_date", part.alias("part"),
            F.explode(F.array(entry("device", "device_hash"), entry("asset", "asset_id"), entry("day", "core_date"))).alias("e"),
        )
        .select("*", "e.*")
        .groupBy("c17", "kind", "id")
        .agg(
            F.count(own(F.lit(1))).alias("n"), F.sum(own("mp_value")).alias("mp_value"),
            F.sum(own("match_distance_meter")).alias("distance"), F.count(own("match_distance_meter")).alias("distances"),
            F.min("lat").alias("lat"), F.min_by("lon", "lat").alias("lon"),
            F.min("core_date").alias("first_date"), F.max("core_date").alias("last_date"),
            *[F.max(own((F.col("part") == p).cast("int"))).alias(p) for p in parts],
        )
    )

    def distinct(kind: str) -> Column:
        return F.count(F.when(F.col("kind") == kind, F.col("id")))

    return (
        ids.groupBy("c17")
        .agg(
            F.sum("n").alias("exposure_count"),
            distinct("device").alias("unique_devices"), distinct("asset").alias("unique_assets"),
            F.sum("mp_value").alias("total_impressions"), distinct("day").alias("days_active"),
            F.min("lat").alias("lat"), F.min_by("lon", "lat").alias("lon"),
            *[F.count(F.when((F.col(p) == 1) & F.col("id").isNotNull(), 1)).alias(f"{p}_devices") for p in parts],
            (F.sum("distance") / F.sum("distances")).alias("avg_distance_m"),
            F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date"),
        )
        .where(F.col("exposure_count") >= min_rows)
        .orderBy(F.desc("total_impressions"), "c17")
    )


def daypart_share(exposures: DataFrame, market_id=None, tz: str = "America/Los_Angeles") -> DataFrame:
    """Share of impressions before 11:00, from 11:00 and from 18:00 local time."""
    hour = local_hour(F.col("device_time"), tz)
    rows = (
        exposures.where(equals("market_id", market_id) & F.col("c17").isNotNull())
        .groupBy(daypart(hour).alias("daypart")).agg(F.sum("mp_value").alias("mp_value"))
    )
    total = F.sum("mp_value")
    return rows.agg(*[
        pct(sum_if(F.col("daypart") == p, F.col("mp_value")), total).alias(f"{p}_pct")
        for p in ("morning", "afternoon", "evening")
    ])
