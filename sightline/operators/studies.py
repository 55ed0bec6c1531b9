"""Proximity, conversion and control-group studies."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sightline.functions.scalars import between_dates, device_bin, equals, in_list, info_field, ratio, with_point
from sightline.functions.timebins import utc_clock
from sightline.operators.multiplier import apply_multiplier
from sightline.operators.ordering import first_n_by, hash_sample
from sightline.operators.spatial import distance_ring, spatial_join, within_radius
from sightline.operators.storage import sized

MILE_M = 1609.34


def _period(df: DataFrame, dma: int | None, start: dt.date | None, end: dt.date | None) -> DataFrame:
    return df.where(between_dates("core_date", start, end) & equals("dma_code", dma))


def exposures_for_frames(
    exposures: DataFrame, multiplier: DataFrame, frame_ids: Sequence | DataFrame | None = None,
    start: dt.date | None = None, end: dt.date | None = None,
) -> DataFrame:
    """Weighted exposures of the chosen frames: a list, a DataFrame of frame_id, or all."""
    rows = exposures.where(between_dates("core_date", start, end))
    if isinstance(frame_ids, DataFrame):
        rows = rows.join(sized(frame_ids.select("frame_id").distinct()), "frame_id", "left_semi")
    else:
        rows = rows.where(in_list("frame_id", frame_ids))
    return apply_multiplier(rows, multiplier).withColumn("device_hash_bin", device_bin(F.col("device_hash")))


def _facing(exposures: DataFrame, frame_id, max_angle: float) -> DataFrame:
    angle = info_field(exposures, "match_info", "MATCH_ANGLE_DEGREE")
    return with_point(exposures).where(
        equals("frame_id", frame_id) & (F.col("viewability") != "DECAYED") & (angle < max_angle) & (angle > -max_angle)
    ).select("frame_id", "device_hash", "lon", "lat", "viewability")


def exposure_affinity_points(exposures: DataFrame, affinities: DataFrame, frame_id=None, max_angle: float = 65) -> DataFrame:
    """Where the well-facing exposures happened, with each affinity of the device."""
    attributes = affinities.select("device_hash", F.col("audience_attribute").alias("affinity_attribute"))
    return _facing(exposures, frame_id, max_angle).join(attributes, "device_hash").drop("device_hash")


def exposure_home_locations(
    exposures: DataFrame, common_locations: DataFrame, frame_id=None, max_angle: float = 65
) -> DataFrame:
    """The same with the device's usual daytime and evening places."""
    places = common_locations.select("device_hash", "cdl_city", "cel_city", "cel_zip", "cdl_zip")
    return _facing(exposures, frame_id, max_angle).join(places, "device_hash").drop("device_hash")


def high_activity_devices(
    pings: DataFrame, exposures: DataFrame, dma: int | None = None, start: dt.date | None = None,
    end: dt.date | None = None, min_avg: float = 10,
) -> DataFrame:
    """Exposed devices whose mean pings per active day exceed ``min_avg``."""
    exposed = exposures.select("device_hash").distinct()
    return (
        _period(pings, dma, start, end)
        .groupBy("device_hash", "core_date").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("device_hash").agg(F.avg("n").alias("avg_daily_pings"))
        .where(F.col("avg_daily_pings") > min_avg)
        .join(exposed, "device_hash", "left_semi")
    )


def sample_devices(exposures: DataFrame, k: int = 50, seed: int = 0) -> DataFrame:
    """``k`` distinct devices picked by a seeded hash."""
    return hash_sample(exposures.select("device_hash").distinct(), k, ["device_hash"], seed)


def poi_dwell(
    pings: DataFrame, devices: DataFrame, pois: DataFrame, radius_m: float = 15, min_pings: int = 5,
    dma: int | None = None, start: dt.date | None = None, end: dt.date | None = None,
) -> DataFrame:
    """Devices with enough pings beside a point of interest, and their mean distance."""
    # The points drop nearly all pings where they are read; only what is left is shuffled to meet the devices.
    near = spatial_join(
        _period(pings, dma, start, end).select("device_hash", "lat", "lon"),
        pois.select("poi_id", "poi_name", "poi_lat", "poi_lon"), radius_m, right_at=("poi_lat", "poi_lon"),
    ).join(devices.select("device_hash").distinct(), "device_hash", "left_semi")
    return (
        near.groupBy("device_hash", "poi_id", "poi_name")
        .agg(F.avg(F.round("distance_m").cast("int")).alias("avg_distance_m"), F.count(F.lit(1)).alias("nearby_pings"))
        .where(F.col("nearby_pings") >= min_pings)
        .orderBy("avg_distance_m", "device_hash", "poi_id")
    )


def poi_visitor_trails(
    pings: DataFrame, exposures: DataFrame, active: DataFrame, pois: DataFrame, radius_m: float = 15,
    dma: int | None = None, start: dt.date | None = None, end: dt.date | None = None,
) -> DataFrame:
    """Every ping of the exposed, active devices seen beside a target point, per point's name."""
    wanted = (
        active.select("device_hash").distinct()
        .join(exposures.select("device_hash").distinct(), "device_hash", "left_semi")
    )
    trail = _period(pings, dma, start, end).select("device_hash", "lat", "lon", "unix_ts")
    visited = spatial_join(
        trail, pois.select("poi_name", "poi_lat", "poi_lon"), radius_m, right_at=("poi_lat", "poi_lon")
    ).select("device_hash", "poi_name").distinct().join(wanted, "device_hash", "left_semi")
    return trail.join(visited, "device_hash").select("device_hash", "lat", "lon", "unix_ts", "poi_name")


def poi_conversions(
    pings: DataFrame, lat: float, lon: float, radius_m: float = 50, dma: int | None = None,
    start: dt.date | None = None, end: dt.date | None = None,
) -> DataFrame:
    """Pings beside one point, with the distance."""
    return within_radius(_period(pings, dma, start, end), "lat", "lon", lat, lon, radius_m).select(
        "device_hash", F.col("lat").alias("device_lat"), F.col("lon").alias("device_lon"),
        F.col("unix_ts").alias("device_ts"), F.col("distance_m").alias("distance_meters"),
    )


def ring_inventory(
    inventory: DataFrame, lat: float, lon: float, min_m: float = MILE_M, max_m: float = 3 * MILE_M,
    owner_id=None, market_id=None, inventory_type: str | None = "billboards", date_range: str | None = None,
) -> DataFrame:
    """Inventory in a ring round a point, one row per coordinate (its smallest inventory id)."""
    wanted = (
        equals("owner_id", owner_id) & equals("market_id", market_id) & equals("inventory_type", inventory_type)
        & equals("date_range", date_range) & F.col("geopath_id").isNotNull()
    )
    return (
        distance_ring(inventory.where(wanted), "lat", "lon", lat, lon, min_m, max_m)
        .groupBy("lat", "lon").agg(F.min(F.struct("inventory_id", "geopath_id")).alias("_first"))
        .select(F.col("_first.inventory_id").alias("frame_id"), F.col("_first.geopath_id").alias("geopath_id"), "lat", "lon")
    )


def top_converting_frames(
    exposures: DataFrame, ring: DataFrame, conversions: DataFrame, k: int = 10, market_id=None, owner_id=None,
    start: dt.date | None = None, end: dt.date | None = None,
) -> DataFrame:
    """The ``k`` frames of the ring that most converted devices were exposed to; ties by frame id."""
    converted = conversions.select("device_hash").distinct()
    rows = exposures.where(between_dates("core_date", start, end) & equals("market_id", market_id) & equals("owner_id", owner_id))
    return (
        rows.select("frame_id", "device_hash").join(sized(ring), "frame_id").distinct()
        .join(converted, "device_hash", "left_semi")
        .groupBy("frame_id", "geopath_id", "lat", "lon")
        .agg(F.count("device_hash").alias("converted_devices"))
        .orderBy(F.desc("converted_devices"), "frame_id").limit(k)
    )


def exposed_devices(
    exposures: DataFrame, top_frames: DataFrame, market_id=None, owner_id=None, start: dt.date | None = None,
    end: dt.date | None = None,
) -> DataFrame:
    """Exposures on the chosen frames."""
    places = top_frames.select("frame_id", "geopath_id", F.col("lat").alias("frame_lat"), F.col("lon").alias("frame_lon"))
    rows = exposures.where(between_dates("core_date", start, end) & equals("market_id", market_id) & equals("owner_id", owner_id))
    return rows.join(places, "frame_id").select(
        "frame_id", "geopath_id", "frame_lat", "frame_lon", "device_hash", F.col("device_time").alias("exposed_ts"),
        "viewability", "match_info", "c14", "c17",
    )


def control_group(
    pings: DataFrame, exposed: DataFrame, dma: int | None = None, start: dt.date | None = None, end: dt.date | None = None
) -> DataFrame:
    """Pings of as many unexposed devices as there are exposed ones, from the same fine cells, by id order."""
    rows = _period(pings, dma, start, end)
    known = exposed.select("device_hash").where(F.col("device_hash").isNotNull()).distinct()
    candidates = (
        rows.join(sized(exposed.select("c17").distinct()), "c17", "left_semi")
        .select("device_hash").distinct().join(known, "device_hash", "left_anti")
    )
    chosen = first_n_by(candidates, "device_hash", known.agg(F.count(F.lit(1))))
    return rows.join(chosen, "device_hash", "left_semi").select(
        "device_hash", "lat", "lon", "unix_ts", utc_clock(F.col("unix_ts")).alias("time_only"),
        F.timestamp_seconds("unix_ts").alias("full_timestamp"), "c14",
    )


def conversion_rate(group: DataFrame, conversions: DataFrame, scale: float = 10) -> DataFrame:
    """Converted devices of a group against its devices divided by ``scale``, in percent."""
    converted = conversions.select("device_hash").distinct().withColumn("converted", F.lit(1))
    return (
        group.select("device_hash").distinct().join(converted, "device_hash", "left")
        .agg((F.count("device_hash") / scale).alias("total_devices"), F.count("converted").alias("converted_devices"))
        .withColumn("conversion_rate", ratio(F.col("converted_devices"), F.col("total_devices")) * 100.0)
    )


def conversion_rate_control(control: DataFrame, conversions: DataFrame, scale: float = 10) -> DataFrame:
    return conversion_rate(control, conversions, scale)


def conversion_rate_exposed(exposed: DataFrame, conversions: DataFrame, scale: float = 10) -> DataFrame:
    return conversion_rate(exposed, conversions, scale)


def exposed_vs_converted(exposed: DataFrame, conversions: DataFrame) -> DataFrame:
    """Per converted device its first exposure, with that sighting's details, and last conversion.

    Each side is reduced to one row per device before the join.
    """
    angle, distance = (info_field(exposed, "match_info", k) for k in ("MATCH_ANGLE_DEGREE", "MATCH_DISTANCE_METER"))
    first = exposed.groupBy("device_hash").agg(
        F.min(
            F.struct(
                "exposed_ts", "frame_id", angle.alias("match_angle_degree"), distance.alias("match_distance_meter"), "viewability"
            )
        ).alias("_first")
    )
    last = conversions.groupBy("device_hash").agg(F.max("device_ts").alias("converted_ts"))
    return first.join(last, "device_hash").select(
        "device_hash", "_first.match_angle_degree", "_first.match_distance_meter", "_first.viewability",
        "_first.exposed_ts", "converted_ts",
    )


def filter_inventory(
    inventory: DataFrame, owner_id=None, date_range: str | None = None, market_ids: Sequence | None = None,
    postcodes: Sequence | None = None, inventory_filters: Sequence[str] | None = None,
) -> DataFrame:
    """Inventory by owner, period, market, postcode and ``type.subtype``; None means no filter."""
    kind = F.concat_ws(".", "inventory_type", "inventory_subtype")
    return inventory.where(
        equals("owner_id", owner_id) & equals("date_range", date_range)
        & in_list("market_id", market_ids) & in_list("postcode", postcodes)
    ).where(F.lit(True) if inventory_filters is None else kind.isin(list(inventory_filters)))


def inventory_json_fields(inventory: DataFrame, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """inventory_id with fields of its JSON columns; ``fields`` maps a name to (column, key path)."""
    def pick(column: str, path: str) -> Column:
        steps = "".join(f"['{key}']" for key in path.split("."))
        return F.get_json_object(column, f"${steps}")

    return inventory.select("inventory_id", *[pick(*at).alias(name) for name, at in fields.items()])


def lookup_rows(table: DataFrame, column: str, ids: Sequence | DataFrame) -> DataFrame:
    """Rows whose ``column`` is in a list or in a one-column DataFrame."""
    if isinstance(ids, DataFrame):
        wanted = ids.select(F.col(ids.columns[0]).alias(column)).distinct()
        return table.join(sized(wanted), column, "left_semi").select(*table.columns)
    return table.where(F.col(column).isin(list(ids)))


def formatted_count(table: DataFrame, predicate: Column | str | None = None) -> DataFrame:
    """Row count with thousands separators."""
    rows = table if predicate is None else table.where(predicate)
    return rows.agg(F.format_number(F.count(F.lit(1)), 0).alias("n"))
