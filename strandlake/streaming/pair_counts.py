"""Pair counts over time windows of an event stream. Ours: the domain itself is batch only.

Counts are additive, so a tumbling window with a watermark can hold them as plain aggregates: state is one
row per window and pair of event types, whatever the number of events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_types(events: DataFrame, size: str = "1 day", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n, total) of a stream or table (ts, event_type, value); later than ``late`` is dropped by a stream."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    g = e.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def windowed_pairs(events: DataFrame, size: str = "1 day", late: str = "2 hours") -> DataFrame:
    """(start, a, b, n): how often an event of type a and one of type b of the same user and window come together, a <= b, from per-user counts.

    On a stream the per-user counts are state; the pairing itself is stateless on closed windows.
    """
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    per = e.groupBy(F.window("ts", size).alias("w"), "user_id").agg(F.sort_array(F.collect_set("event_type")).alias("types"))
    pair = F.expr("flatten(transform(types, (x, k) -> transform(slice(types, k + 1, size(types)), y -> struct(x as a, y as b))))")
    return per.select(F.col("w.start").alias("start"), F.explode(pair).alias("p")).select("start", "p.a", "p.b")
