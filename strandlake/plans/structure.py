"""Queries on structures and contacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators import contacts as C
from strandlake.operators import structure as T
from strandlake.plans import oracle as O
from strandlake.plans.covariation import rnd
from strandlake.plans.significance import _E, _evalues
from strandlake.tables import once, table


def _ct(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = once(table(spark, sf_dir, "alignments"), "aln_id", "ss_cons")
    return T.wuss_pairs(a.withColumnRenamed("ss_cons", "ss"))


def wuss_pairs(spark, sf_dir) -> DataFrame:
    """Pairs of every consensus structure."""
    return _ct(spark, sf_dir)


def helices(spark, sf_dir) -> DataFrame:
    return T.helices(_ct(spark, sf_dir), 2)


def contacts_ct(spark, sf_dir) -> DataFrame:
    return C.from_pairs(_ct(spark, sf_dir), 5)


def wuss_again(spark, sf_dir) -> DataFrame:
    """Structures written again from their pairs."""
    a = once(table(spark, sf_dir, "alignments"), "aln_id", "ss_cons").where("ss_cons IS NOT NULL")
    return T.pairs_wuss(_ct(spark, sf_dir), a.select("aln_id", F.length("ss_cons").alias("alen")))


def contacts_3d(spark, sf_dir) -> DataFrame:
    """Vectors as atoms in three dimensions, ten atoms a residue, labels as chains."""
    e = table(spark, sf_dir, "embeddings")
    at = [F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate("xyz")]
    atoms = e.select(F.concat(F.lit("L"), F.col("label").cast("string")).alias("aln_id"), F.floor(F.col("vec_id") / 10).cast("int").alias("resnum"), *at)
    return C.from_atoms(atoms, 0.05, 3).select("aln_id", "i", "j", rnd(F.col("dist"), 7).alias("dist"))


def covariation_layers(spark, sf_dir) -> DataFrame:
    """Nested layers of the pairs with E below 20."""
    return T.max_covariation(_evalues(spark, sf_dir).select("aln_id", "i", "j", rnd(F.col("evalue"), 9).alias("evalue")), 20.0)


def ranked_contacts(spark, sf_dir) -> DataFrame:
    """Running counts of base pairs down the ranking by score."""
    ev = _evalues(spark, sf_dir)
    return C.roc_by_rank(ev.select("aln_id", "i", "j", "score"), ev.where("is_bp"), 4).select("aln_id", "rank", "found", F.col("hits").cast("long").alias("hits"))


QUERIES = {f.__name__: f for f in (wuss_pairs, helices, contacts_ct, wuss_again, contacts_3d, covariation_layers, ranked_contacts)}

_CT = """WITH a AS (SELECT aln_id, min(ss_cons) AS ss FROM alignments WHERE aln_id IS NOT NULL GROUP BY 1),
ch AS (SELECT aln_id, k, ss[k] AS c FROM a, LATERAL (SELECT unnest(range(1, length(ss) + 1)) AS k)),
kd AS (SELECT *, CASE WHEN c IN ('<', '>') THEN '1' WHEN c IN ('(', ')') THEN '2' WHEN c IN ('[', ']') THEN '3' WHEN c IN ('{', '}') THEN '4' ELSE upper(c) END AS kind, c IN ('<', '(', '[', '{') OR c BETWEEN 'A' AND 'Z' AS op FROM ch WHERE regexp_matches(c, '^[<>(){}A-Za-z]$') OR c IN ('[', ']')),
dp AS (SELECT *, sum(CASE WHEN op THEN 1 ELSE -1 END) OVER (PARTITION BY aln_id, kind ORDER BY k) + CASE WHEN op THEN 0 ELSE 1 END AS d FROM kd),
rn AS (SELECT *, row_number() OVER (PARTITION BY aln_id, kind, d, op ORDER BY k) AS r FROM dp),
ct AS (SELECT o.aln_id, CASE WHEN o.kind < 'A' THEN 'nested' ELSE 'pk' || o.kind END AS layer, CAST(o.k AS INTEGER) AS i, CAST(c.k AS INTEGER) AS j FROM rn o JOIN rn c ON o.aln_id = c.aln_id AND o.kind = c.kind AND o.d = c.d AND o.r = c.r AND o.op AND NOT c.op)"""
ORACLE = {
    "wuss_pairs": _CT + " SELECT * FROM ct",
    "helices": _CT + """, l AS (SELECT *, lag(i) OVER w AS pi, lag(j) OVER w AS pj FROM ct WINDOW w AS (PARTITION BY aln_id, layer ORDER BY i)),
h AS (SELECT *, sum(CASE WHEN pi IS NULL OR pj <= j OR i - pi - 1 + pj - j - 1 > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY aln_id, layer ORDER BY i) AS helix FROM l)
SELECT aln_id, layer, CAST(helix AS INTEGER) AS helix, count(*) AS n_pairs, min(i) AS i_out, max(j) AS j_out, max(i) AS i_in, min(j) AS j_in FROM h GROUP BY aln_id, layer, helix""",
    "contacts_ct": _CT + " SELECT aln_id, i, j, 'WWc' AS cttype, min(layer) <> 'nested' AS ispk FROM ct WHERE j - i >= 5 GROUP BY 1, 2, 3",
    "wuss_again": "SELECT aln_id, regexp_replace(regexp_replace(regexp_replace(min(ss_cons), '[(\\[{]', '<', 'g'), '[)\\]}]', '>', 'g'), '[^<>A-Za-z]', ':', 'g') AS ss FROM alignments WHERE aln_id IS NOT NULL GROUP BY aln_id HAVING min(ss_cons) IS NOT NULL",
    "contacts_3d": f"""WITH t AS (SELECT 'L' || label AS aln_id, CAST(vec_id // 10 AS INTEGER) AS r, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings),
d AS (SELECT a.aln_id, a.r AS i, b.r AS j, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS d FROM t a JOIN t b ON a.aln_id = b.aln_id AND b.r - a.r + 1 > 3)
SELECT aln_id, i, j, {O.r("min(d)", "dist", 7)} FROM d WHERE d < 0.05 GROUP BY 1, 2, 3""",
    "ranked_contacts": _E + """ SELECT aln_id, CAST(row_number() OVER w AS INTEGER) AS rank, count(*) OVER w AS found, CAST(sum(CAST(is_bp AS INTEGER)) OVER w AS BIGINT) AS hits FROM ev WHERE j - i >= 4 WINDOW w AS (PARTITION BY aln_id ORDER BY score DESC, i, j)""",
}
