"""Exposure round a venue on the days before and after an event."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from sightline.functions.scalars import between_dates
from sightline.functions.timebins import event_window, relative_day, summary_hour
from sightline.operators.multiplier import weighted_totals
from sightline.operators.spatial import within_radius
from sightline.operators.storage import sized

SEEN = ("LIKELY_TO_SEE", "OPPORTUNITY_TO_SEE")


def venue_frames(frames: DataFrame, lat: float, lon: float, radius_m: float = 8000) -> DataFrame:
    """Ids of the frames near a venue, broadcast if they fit."""
    return sized(within_radius(frames, "site_lat", "site_lon", lat, lon, radius_m).select("frame_id").distinct())


def event_frame_count(
    exposures: DataFrame, frames: DataFrame, lat: float, lon: float, radius_m: float = 8000,
    start: dt.date | None = None, end: dt.date | None = None,
) -> DataFrame:
    """Exposures on the frames near a venue."""
    near = venue_frames(frames, lat, lon, radius_m)
    return (
        exposures.where(between_dates("core_date", start, end)).join(near, "frame_id", "left_semi")
        .agg(F.count(F.lit(1)).alias("exposures"))
    )


def event_weighted_hourly(
    exposures: DataFrame, frames: DataFrame, multiplier: DataFrame, event_date: dt.date, lat: float, lon: float,
    radius_m: float = 8000, weeks: tuple[int, int] = (-4, 2),
) -> DataFrame:
    """Frequencies and weights per frame and hour near a venue, with the day relative to the event.

    The hourly figures are sums over devices, so rows are summed per cell-hour and band before
    they meet the multiplier.
    """
    start, end = event_window(event_date, -weeks[0], weeks[1])
    rows = (
        exposures.where(between_dates("core_date", start, end))
        .join(venue_frames(frames, lat, lon, radius_m), "frame_id", "left_semi")
        .withColumn("summary_hour", summary_hour(F.col("device_time")))
    )
    keys = ["core_date", "owner_id", "market_id", "frame_id", "summary_hour"]
    lts = F.col("viewability") == SEEN[0]
    ots = F.col("viewability").isin(*SEEN)

    def total(value: str, when: Column | None = None) -> Column:
        v = F.col(value).cast("double")
        return F.sum(v if when is None else F.when(when, v).otherwise(0.0))

    return (
        weighted_totals(rows, multiplier, [*keys, "viewability"])
        .groupBy(*keys)
        .agg(
            total("exposures", lts).alias("freq_lts"), total("exposures", ots).alias("freq_ots"),
            total("exposures").alias("freq_gross"),
            total("mp_value", lts).alias("weight_lts"), total("mp_value", ots).alias("weight_ots"),
            total("mp_value").alias("weight_gross"),
        )
        .withColumn("relative_day", relative_day(F.col("core_date"), event_date))
        .orderBy("core_date", "frame_id", "summary_hour")
    )
