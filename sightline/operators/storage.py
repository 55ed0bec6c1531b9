"""Upserts, partitioned writes and the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType


# What a side may have to be broadcast: rows, and bytes by the width of its schema.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``, else the context's checkpoint
    folder, else one inside the session's warehouse.
    """
    context, folder = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None)
    if not folder and context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return (folder or context.getCheckpointDir()).rstrip("/")


_PATHS: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    _PATHS.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _PATHS[-1]


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove, at the end of the block, the tables that operators wrote to the shared folder within it.

    What operators return reads them, so results are to be stored before. Checkpoints are Spark's own to remove:
    set ``spark.cleaner.referenceTracking.cleanCheckpoints``.
    """
    begin = len(_PATHS)
    try:
        yield
    finally:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in _PATHS[begin:]:
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)
        del _PATHS[begin:]


def kept(df: DataFrame) -> DataFrame:
    """The rows, computed once: a reliable checkpoint in the shared folder, lineage cut."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def row_width(schema: StructType) -> int:
    """Bytes a row is taken to have: 8 a value, 40 a string, 400 an array, map or other nested value."""
    def width(kind) -> int:
        if isinstance(kind, StructType):
            return sum(width(f.dataType) for f in kind.fields)
        return 400 if isinstance(kind, (ArrayType, MapType)) else 40 if isinstance(kind, (StringType, BinaryType)) else 8

    return width(schema)


def fits(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Whether a dimension-sized table has at most ``max_rows`` rows and BROADCAST_BYTES bytes, counted by a job of its own."""
    most = min(max_rows, BROADCAST_BYTES // max(1, row_width(df.schema)))
    return df.limit(most + 1).count() <= most


def sized(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it fits, else unmarked and joined as Spark decides.

    Spark estimates sizes before the filters and explosions that make such a side small, and a
    join it first plans as a shuffle moves the large side even if the small one turns out tiny.
    """
    return F.broadcast(df) if fits(df, max_rows) else df


def save_table(df: DataFrame, path: str) -> DataFrame:
    """Write a result as parquet and read it back, as a stage of a longer study."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``source`` replace rows of ``target`` with the same keys; the rest is kept."""
    kept = target.join(source.select(*keys), list(keys), "left_anti")
    return kept.select(*target.columns).unionByName(source.select(*target.columns))


def write_partitions(
    df: DataFrame, path: str, day: str = "core_date", sort: Sequence[str | Column] = (), mode: str = "overwrite",
    compression: str = "snappy",
) -> None:
    """Write parquet partitioned by day, each day spread over several files and sorted inside them.

    Ranges of (day, sort columns) give each file a narrow min/max to skip by, and as many files as the
    data fill. The input partition is the last key, so that many rows with equal keys, even exact
    copies, do not end in one task; it is the same when a task is run again.
    """
    by = [day, *sort]
    placed = df.withColumn("_from", F.spark_partition_id()).repartitionByRange(*by, "_from")
    writer = placed.drop("_from").sortWithinPartitions(*by).write.mode(mode).option("compression", compression)
    if mode == "overwrite":
        writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(day).parquet(path)


def upsert_partitions(
    spark: SparkSession, path: str, source: DataFrame, keys: Sequence[str], day: str = "core_date",
    sort: Sequence[str] = (),
) -> None:
    """Upsert into a parquet table partitioned by day, reading and rewriting only the days in ``source``.

    A key never moves to another day: its bin start fixes its day. The days of a run are listed, so that
    other partitions are not opened. The new days are written to a staging folder first and replace the old
    ones in one commit; if it fails before, the table is as it was.
    """
    source = kept(source)
    old = days_of(spark.read.parquet(path), source, day)
    staged = save_table(upsert(old, source, keys).select(*old.columns), new_path(spark, "upsert"))
    write_partitions(staged, path, day, sort)


def days_of(table: DataFrame, source: DataFrame, day: str = "core_date") -> DataFrame:
    """The rows of ``table`` on the days that ``source`` has, as a filter that prunes partitions."""
    days = [r[0] for r in source.select(day).distinct().collect()]
    return table.where(F.col(day).isin(days))


def counts_by_date(df: DataFrame, day: str = "core_date") -> DataFrame:
    return df.groupBy(day).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc(day))
