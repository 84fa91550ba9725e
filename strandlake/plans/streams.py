"""The windowed counts of events, run as batch over the whole table; tests run the same plan as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.plans import oracle as O
from strandlake.plans.covariation import rnd
from strandlake.streaming.pair_counts import windowed_pairs, windowed_types
from strandlake.tables import table


def windowed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = windowed_types(table(spark, sf_dir, "events"))
    return w.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", rnd(F.col("total"), 4).alias("total"))


def windowed_event_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = windowed_pairs(table(spark, sf_dir, "events"))
    return w.groupBy(F.date_format("start", "yyyy-MM-dd").alias("day"), "a", "b").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {"windowed_events": windowed_events, "windowed_event_pairs": windowed_event_pairs}
ORACLE = {
    "windowed_events": f"SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, {O.r('sum(value)', 'total', 4)} FROM events GROUP BY 1, 2",
    "windowed_event_pairs": "WITH u AS (SELECT DISTINCT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, user_id, event_type AS t FROM events) SELECT x.day, x.t AS a, y.t AS b, count(*) AS n FROM u x JOIN u y ON x.day = y.day AND x.user_id = y.user_id AND x.t <= y.t GROUP BY ALL",
}
