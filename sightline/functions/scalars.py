"""Small scalar rules shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

METERS_TO_MILES = 0.000621371


def div0(numerator: Column, denominator: Column) -> Column:
    """Division that answers 0 when the divisor is 0 and NULL when either side is NULL."""
    n, d = numerator.cast("double"), denominator.cast("double")
    return F.when(d == 0, F.when(n.isNotNull(), F.lit(0.0))).otherwise(n / d)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that answers NULL when the divisor is 0."""
    d = denominator.cast("double")
    return F.when(d != 0, numerator.cast("double") / d)


def report_round(value: Column, digits: int = 2) -> Column:
    """Half-up rounding that a last-bit difference of a floating sum cannot tip.

    Spark rounds by decimals, a microsecond a value. A value clear of a tie has but one nearest number, which a division of
    two whole numbers gives exactly; only those near a tie, and huge or missing ones, take the decimals.
    """
    if not 0 <= digits <= 8:
        return F.round(F.round(value, digits + 7), digits)
    scaled = value.cast("double") * F.lit(10.0**digits)
    clear = (F.abs(scaled) < 1e9) & (F.abs(scaled - F.floor(scaled) - 0.5) > 1e-5)
    return F.when(clear, F.floor(scaled + 0.5) / F.lit(10.0**digits)).otherwise(F.round(F.round(value, digits + 7), digits))


def pct(part: Column, whole: Column, digits: int = 2) -> Column:
    return report_round(ratio(part, whole) * 100.0, digits)


def sum_if(condition: Column, value: Column) -> Column:
    return F.sum(F.when(condition, value).otherwise(F.lit(0.0)))


def in_list(column: str, values: Sequence | None) -> Column:
    """Membership test that lets every row through when there is no list."""
    return F.lit(True) if values is None else F.col(column).isin(list(values))


def between_dates(column: str, start=None, end=None) -> Column:
    keep = F.lit(True)
    if start is not None:
        keep = keep & (F.col(column) >= F.lit(start).cast("date"))
    if end is not None:
        keep = keep & (F.col(column) <= F.lit(end).cast("date"))
    return keep


def equals(column: str, value) -> Column:
    """Equality that lets every row through when there is no value."""
    return F.lit(True) if value is None else F.col(column) == F.lit(value)


def info_field(df: DataFrame, column: str, key: str, as_type: str = "double") -> Column:
    """One key of a semi-structured column held as a struct or as JSON text."""
    if isinstance(df.schema[column].dataType, StringType):
        return F.get_json_object(column, f"$.{key}").cast(as_type)
    return F.col(column).getField(key).cast(as_type)


def with_point(df: DataFrame) -> DataFrame:
    """``lat`` and ``lon`` as columns, taken from a ``device_geog`` struct where the table has that."""
    if "lat" in df.columns or "device_geog" not in df.columns:
        return df
    return df.withColumns({"lat": F.col("device_geog.lat"), "lon": F.col("device_geog.lon")})


def uniform(row_id: Column, step: int | str, seed: int) -> Column:
    """A draw from [0, 1) fixed by the row, the step and the seed.

    A recomputed task draws the same number, which ``rand`` does not promise.
    """
    text = F.concat_ws(":", row_id.cast("string"), F.lit(str(step)), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0


def device_bin(device: Column, bins: int = 100) -> Column:
    return F.pmod(F.xxhash64(device), F.lit(bins).cast("bigint"))


def numeric_bin(number: Column, width: int = 100) -> Column:
    return F.floor(number / width).cast("bigint")
