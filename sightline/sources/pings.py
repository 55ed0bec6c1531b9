"""Raw ping files: path lists, typed reading, indexing and the dated parquet table."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from sightline.functions.cells import cell, cell_parent, curve_key
from sightline.functions.timebins import utc_date
from sightline.operators.storage import write_partitions

# The raw file layout and the ingested column order.
RAW_SCHEMA = StructType(
    [
        StructField("device_id", StringType()),
        StructField("unix_ts", LongType()),
        StructField("lat", DoubleType()),
        StructField("lon", DoubleType()),
        StructField("datasource_id", IntegerType()),
        StructField("accuracy", IntegerType()),
        StructField("device_ip", StringType()),
        StructField("user_agent", StringType()),
        StructField("publisher_id", IntegerType()),
        StructField("make", StringType()),
        StructField("os", StringType()),
        StructField("os_version", StringType()),
        StructField("categories", StringType()),
        StructField("country_code", StringType()),
        StructField("market_hash", StringType()),
    ]
)
INGESTED_COLUMNS = [
    "core_date", "device_id", "timestamp", "unix_ts", "lat", "lon", "device_geo", "datasource_id", "accuracy",
    "device_ip", "user_agent", "publisher_id", "make", "os", "os_version", "categories", "country_code",
    "market_hash", "c25", "c20", "c17", "c14", "c11",
]
FINEST_ZOOM = 25
PARENT_ZOOMS = (20, 17, 14, 11)


def backfill_paths(root: str, markets: Sequence[str], start: dt.date, end: dt.date, parts: int | None = None) -> list[str]:
    """Input paths of each market and calendar day: one glob a day, or its numbered part files."""
    days = [start + dt.timedelta(days=i) for i in range((end - start).days + 1)]
    folders = [f"{root.rstrip('/')}/{market}/{day:%Y/%m/%d}" for day in days for market in markets]
    if parts is None:
        return [f"{folder}/part-*.gz" for folder in folders]
    return [f"{folder}/part-{i:05d}.gz" for folder in folders for i in range(parts)]


def backfill_path_rows(root: str, markets: DataFrame, pings: DataFrame, day: str = "core_date") -> DataFrame:
    """``path``: one glob for each market hash and calendar day from the first day of ``pings`` to the last."""
    days = F.sequence(
        pings.agg(F.min(day)).scalar(), pings.agg(F.max(day)).scalar(), F.expr("interval 1 day")
    )
    return markets.select("markethash", F.explode(days).alias("_day")).select(F.concat(
        F.lit(root.rstrip("/") + "/"), "markethash", F.lit("/"), F.date_format("_day", "yyyy/MM/dd"), F.lit("/part-*.gz")
    ).alias("path"))


def read_raw_pings(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """All files in one read, by the declared schema."""
    return spark.read.schema(RAW_SCHEMA).option("sep", "\t").csv(paths if isinstance(paths, str) else list(paths))


def index_pings(raw: DataFrame) -> DataFrame:
    """Raw pings with day, timestamp, point and cells, in the ingested column order."""
    finest = cell(F.col("lat"), F.col("lon"), FINEST_ZOOM)
    return (
        raw.withColumn("c25", finest)
        .withColumns({f"c{z}": cell_parent(F.col("c25"), z) for z in PARENT_ZOOMS})
        .withColumns({
            "timestamp": F.timestamp_seconds("unix_ts"),
            "core_date": utc_date(F.col("unix_ts")),
            "device_geo": F.struct("lon", "lat"),
        })
        .select(*INGESTED_COLUMNS)
    )


def ingest_pings(
    spark: SparkSession, paths: str | Sequence[str], out: str, mode: str = "overwrite"
) -> None:
    """Read, index and write gzip parquet by day; overwrite replaces the days read, append adds to them.

    A missing or unreadable file fails the job. A day has as many files as its rows fill, each with
    a stretch of the cells' curve, narrow in longitude and latitude.
    """
    write_partitions(
        index_pings(read_raw_pings(spark, paths)), out, sort=[curve_key(F.col("c25"))], mode=mode, compression="gzip"
    )
