"""Scans of the test tables, with the deliveries cleaned the same way everywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def once(df: DataFrame, key: str, *cols: str) -> DataFrame:
    """One row for each non-null ``key``: rows delivered twice carry the same values.

    An aggregate instead of a window: it combines before the shuffle and moves only
    the columns asked for. Of differing values the smallest is kept, for one fixed result.
    """
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(*(F.min(c).alias(c) for c in cols))
