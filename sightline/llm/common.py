"""Helpers the corpus operators share: tables, scratch tables and fresh column names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sightline.operators import storage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, computed once: written as Parquet to the shared folder and read back, lineage cut."""
    return storage.save_table(df, storage.new_path(df.sparkSession, name))


def narrowed(df: DataFrame, **named: str) -> DataFrame:
    """Only the named columns under the operator's own names, so that extra columns cannot clash."""
    return df.select(*[F.col(f"`{source}`").alias(own) for own, source in named.items()])


def fold(id_col: str, folds: int) -> Column:
    """Remainder of the CRC-32 of the identifier's text."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds))
