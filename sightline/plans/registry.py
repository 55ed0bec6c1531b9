"""The registered queries: a name, a Spark plan over the fixtures and the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DecimalType, DoubleType, FloatType

from sightline.functions.scalars import report_round
from sightline.plans.fixtures import Fixtures, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def rounded(df: DataFrame, digits: int) -> DataFrame:
    """Fractions rounded, so that a different summation order does not show."""
    def column(field):
        if isinstance(field.dataType, (DoubleType, FloatType, DecimalType)):
            return (report_round(F.col(field.name).cast("double"), digits) + F.lit(0.0)).alias(field.name)
        return F.col(field.name)

    return df.select(*[column(f) for f in df.schema.fields])


def query(name: str, sql: str | None = None, digits: int = 4):
    """Register a function of the fixtures under ``name``."""
    def register(plan: Callable[[Fixtures], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: rounded(plan(Fixtures(spark, sf_dir)), digits)
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return plan

    return register
