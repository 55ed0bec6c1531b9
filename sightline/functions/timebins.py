"""Epoch-second bins, event windows and dayparts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F

HOUR_S = 3600
DAY_S = 24 * HOUR_S


def hour_bin(epoch: Column) -> Column:
    """Whole hours since the epoch."""
    return F.floor(epoch / HOUR_S).cast("bigint")


def anchored_bin(epoch: Column, start: int, width_s: int) -> Column:
    """Start of the ``width_s`` bin holding ``epoch``, bins counted from ``start``."""
    return (F.lit(start) + width_s * F.floor((epoch - start) / width_s)).cast("bigint")


def summary_hour(epoch: Column) -> Column:
    """Epoch second at which the clock hour began."""
    return epoch - F.pmod(epoch, F.lit(HOUR_S))


def utc_date(epoch: Column) -> Column:
    """UTC day of an epoch second, whatever the session's time zone."""
    return F.date_from_unix_date(F.floor(epoch / DAY_S).cast("int"))


def utc_clock(epoch: Column) -> Column:
    """UTC time of day as HH:mm:ss, whatever the session's time zone."""
    second = F.pmod(epoch, F.lit(DAY_S))
    parts = (F.floor(second / HOUR_S), F.floor(second % HOUR_S / 60), second % 60)
    return F.format_string("%02d:%02d:%02d", *[part.cast("bigint") for part in parts])


def event_window(event: dt.date, weeks_before: int = 4, weeks_after: int = 2) -> tuple[dt.date, dt.date]:
    """First and last day of a study window round an event."""
    return event - dt.timedelta(weeks=weeks_before), event + dt.timedelta(weeks=weeks_after)


def relative_day(day: Column, event: dt.date) -> Column:
    """Signed days from the event: negative before, zero on the day."""
    return F.datediff(day, F.lit(event))


def local_hour(epoch: Column, tz: str = "UTC") -> Column:
    """Hour of the day on a wall clock in ``tz``, whatever the session's time zone."""
    local = epoch if tz == "UTC" else F.from_utc_timestamp(F.timestamp_seconds(epoch), tz).cast("bigint")
    return F.floor(F.pmod(local, F.lit(DAY_S)) / HOUR_S).cast("int")


def daypart(hour: Column, morning_from: int = 0, afternoon_from: int = 11, evening_from: int = 18) -> Column:
    """morning / afternoon / evening by the hour each begins; NULL before the first."""
    return (
        F.when(hour >= evening_from, "evening")
        .when(hour >= afternoon_from, "afternoon")
        .when(hour >= morning_from, "morning")
    )
