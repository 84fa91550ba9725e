"""Alignments in long form, derived from ordinary tables.

Cells are (aln_id, seq, col, res): res 0..3 is a residue, 4 a gap, 5 missing data; an absent cell is a gap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.tables import table

GAP, MISSING = 4, 5


def orders_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as sequences, line numbers as columns, parts as residues, priorities as alignments."""
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg((F.min("l_partkey") % 4).cast("int").alias("res"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_orderpriority").alias("aln_id"), F.col("l_orderkey").alias("seq"), F.col("l_linenumber").cast("int").alias("col"), "res")


def events_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as sequences, days of the month as columns, the day's first event as residue."""
    e = table(spark, sf_dir, "events").groupBy("user_id", F.dayofmonth("ts").alias("col")).agg(F.min_by("event_type", F.struct("ts", "event_id")).alias("t"))
    code = F.when(F.col("t") == "click", 0).when(F.col("t") == "purchase", 1).when(F.col("t") == "signup", 2).when(F.col("t") == "view", 3).otherwise(MISSING)
    return e.select(F.lit("events").alias("aln_id"), F.col("user_id").alias("seq"), F.col("col").cast("int").alias("col"), code.cast("int").alias("res"))


def embeddings_cells(spark: SparkSession, sf_dir: str, t: float = 0.085) -> DataFrame:
    """Vectors as sequences, dimensions as columns, sign and size of a value as residue, labels as alignments."""
    v = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.posexplode("embedding").alias("p", "v"))
    res = 2 * (F.col("v") >= 0).cast("int") + (F.abs(F.col("v").cast("double")) >= t).cast("int")
    return v.select(F.concat(F.lit("L"), F.col("label").cast("string")).alias("aln_id"), F.col("vec_id").alias("seq"), (F.col("p") + 1).cast("int").alias("col"), res.cast("int").alias("res"))
