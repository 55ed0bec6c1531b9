"""Radius filters and the point-to-point radius join."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from sightline.functions.cells import METERS_PER_DEGREE, cell, cover, zoom_for_radius
from sightline.functions.geodesy import distance_m, valid_coords
from sightline.operators.storage import sized


def within_radius(df: DataFrame, lat: str, lon: str, at_lat: float, at_lon: float, radius_m: float) -> DataFrame:
    """Rows within ``radius_m`` of a fixed point, with ``distance_m``.

    The latitude and longitude bands are plain ranges on columns, which parquet can skip by: files laid
    out along the cells' curve (``curve_key``) are narrow in both. Around a pole, or over the 180th meridian, one band is left.
    """
    band = radius_m * 1.01 / METERS_PER_DEGREE
    near = F.col(lat).between(at_lat - band, at_lat + band)
    # The widest longitude on the circle lies toward the nearer pole.
    reach = math.cos(math.radians(min(90.0, abs(at_lat) + band)))
    wide = band / reach if reach > 0 else 360.0
    if wide < 180 and -180 <= at_lon - wide and at_lon + wide <= 180:
        near = near & F.col(lon).between(at_lon - wide, at_lon + wide)
    return (
        df.where(valid_coords(F.col(lat), F.col(lon)))
        .where(near)
        .withColumn("distance_m", distance_m(F.lit(at_lat), F.lit(at_lon), F.col(lat), F.col(lon)))
        .where(F.col("distance_m") <= radius_m)
    )


def distance_ring(
    df: DataFrame, lat: str, lon: str, at_lat: float, at_lon: float, min_m: float, max_m: float
) -> DataFrame:
    """Rows at least ``min_m`` and less than ``max_m`` from a fixed point, with ``distance_m``."""
    near = within_radius(df, lat, lon, at_lat, at_lon, max_m)
    return near.where((F.col("distance_m") >= min_m) & (F.col("distance_m") < max_m))


def spatial_join(
    left: DataFrame, right: DataFrame, radius_m: float,
    left_at: tuple[str, str] = ("lat", "lon"), right_at: tuple[str, str] = ("lat", "lon"),
) -> DataFrame:
    """All pairs of a left and a right point at most ``radius_m`` apart, with ``distance_m``.

    The right points (the smaller side) are copied to the cells their circle may touch,
    then joined on the cell; the exact distance settles the rest. Copies that fit are
    broadcast; beyond that, skewed cells are split by adaptive execution, as it is a plain
    inner equi join.
    """
    zoom = zoom_for_radius(radius_m)
    spread = right.withColumn("_cell", F.explode(cover(F.col(right_at[0]), F.col(right_at[1]), radius_m, zoom)))
    spread = sized(spread)
    placed = left.withColumn("_cell", cell(F.col(left_at[0]), F.col(left_at[1]), zoom))
    gap: Column = distance_m(placed[left_at[0]], placed[left_at[1]], spread[right_at[0]], spread[right_at[1]])
    return (
        placed.join(spread, "_cell")
        .withColumn("distance_m", gap)
        .where(F.col("distance_m") <= radius_m)
        .drop("_cell")
    )
