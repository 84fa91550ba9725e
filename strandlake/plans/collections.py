"""Queries on collections of alignments: per-family counts under skew."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions.sequences import norm_name
from strandlake.operators.skew_profile import key_profile
from strandlake.tables import once, table


def _family_profile(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int, int]:
    seqs = once(table(spark, sf_dir, "seqs").select("seq_id", "aln_id", F.length("aseq").alias("len")), "seq_id", "aln_id", "len")
    alns = once(table(spark, sf_dir, "alignments").select("aln_id", norm_name(F.col("name")).alias("fam"), "nseq", "alen"), "aln_id", "fam", "nseq", "alen")
    return key_profile(seqs, "seq_id", "aln_id", "len", alns, "aln_id", "fam", ("nseq", "alen"))


def p5_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each family's rows, characters and exact size quantiles beside its declared figures."""
    return _family_profile(spark, sf_dir)[0].withColumnsRenamed({"declared_a": "declared_nseq", "declared_b": "declared_alen"})


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families that hold more than 2 % of all rows or of all characters."""
    prof, n, c = _family_profile(spark, sf_dir)
    return prof.where((F.col("n_rows") * 50 > F.lit(n)) | (F.col("n_chars") * 50 > F.lit(c))).select("name")


_P5 = r"""
WITH s AS (SELECT seq_id, min(aln_id) AS aln_id, coalesce(min(length(aseq)), 0) AS len FROM seqs WHERE seq_id IS NOT NULL GROUP BY seq_id),
a AS (SELECT aln_id, min(lower(regexp_replace(name, '^\s+|\s+$', '', 'g'))) AS name, min(nseq) AS nseq, min(alen) AS alen FROM alignments WHERE aln_id IS NOT NULL GROUP BY aln_id),
j AS (SELECT a.name, s.len FROM s JOIN a USING (aln_id) WHERE a.name IS NOT NULL),
r AS (SELECT name, len, row_number() OVER (PARTITION BY name ORDER BY len) AS rn, count(*) OVER (PARTITION BY name) AS n FROM j),
q AS (SELECT name, min(CASE WHEN rn >= ceil(n * 0.5) THEN len END) AS q50, min(CASE WHEN rn >= ceil(n * 0.9) THEN len END) AS q90, count(*) AS n_rows, sum(len) AS n_chars FROM r GROUP BY name),
d AS (SELECT name, count(*) AS n_members, sum(greatest(coalesce(nseq, 0), 0)) AS dn, sum(greatest(coalesce(alen, 0), 0)) AS da FROM a WHERE name IS NOT NULL GROUP BY name)
"""

QUERIES = {"p5_found": p5_found, "p5_profile": p5_profile}
ORACLE = {
    "p5_found": _P5 + "SELECT name FROM q WHERE n_rows * 50 > (SELECT count(*) FROM s) OR n_chars * 50 > (SELECT sum(len) FROM s)",
    "p5_profile": _P5 + "SELECT d.name, CAST(n_members AS BIGINT) AS n_members, CAST(dn AS BIGINT) AS declared_nseq, CAST(da AS BIGINT) AS declared_alen, CAST(coalesce(n_rows, 0) AS BIGINT) AS n_rows, CAST(coalesce(n_chars, 0) AS BIGINT) AS n_chars, CAST(q50 AS BIGINT) AS q50, CAST(q90 AS BIGINT) AS q90 FROM d LEFT JOIN q USING (name)",
}
