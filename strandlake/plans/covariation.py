"""Queries on column pairs: probabilities, statistics and their corrections."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators import pairs as P
from strandlake.operators import pseudo
from strandlake.plans import oracle as O
from strandlake.storage import materialize

SOURCES = {"orders": pseudo.orders_cells, "events": pseudo.events_cells, "embeddings": pseudo.embeddings_cells}


def rnd(c, digits: int = 6):
    return (F.round(c, digits) + F.lit(0.0)).cast("double")


def _pp(spark, sf_dir, source):
    # one row for each column pair, read several times: written once instead of counted again
    return materialize(P.joint(P.joint_counts(SOURCES[source](spark, sf_dir))), "joint")


def _ppm(spark, sf_dir, source):
    return P.with_marginals(_pp(spark, sf_dir, source))


def gtest_apc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: orders as alignments, G-test of every column pair, average product correction."""
    d = _ppm(spark, sf_dir, "orders").select("aln_id", "i", "j", "nseff", P.covariation("gt", "C16").alias("gt"))
    return P.correct(materialize(d, "scores"), "gt").select("aln_id", "i", "j", "nseff", rnd(F.col("gt")).alias("gt"), rnd(F.col("gt_apc")).alias("gtp"))


def cov_stat(spark: SparkSession, sf_dir: str, stat: str, source: str = "embeddings") -> DataFrame:
    """One statistic over all pairs: all cells, pooled cells, and both corrections of the first."""
    d = _ppm(spark, sf_dir, source).select("aln_id", "i", "j", P.covariation(stat, "C16").alias("c16"), P.covariation(stat, "C2").alias("c2"))
    d = P.correct(materialize(d, "scores"), "c16")
    return d.select("aln_id", "i", "j", *(rnd(F.col(c)).alias(c) for c in ("c16", "c2", "c16_apc", "c16_asc")))


def cov_gt_wc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G-test over the allowed cells alone."""
    return _ppm(spark, sf_dir, "embeddings").select("aln_id", "i", "j", rnd(P.covariation("gt", "CWC")).alias("gt_wc"))


def cov_ccf(spark: SparkSession, sf_dir: str) -> DataFrame:
    pp = _pp(spark, sf_dir, "embeddings")
    return P.ccf(pp).select("aln_id", "i", "j", rnd(F.col("ccf"), 5).alias("ccf"))


def cov_raf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RAF and its stacked form."""
    r = P.raf(P.joint_counts(SOURCES["events"](spark, sf_dir)))
    return r.join(P.rafs(r), ["aln_id", "i", "j"]).select("aln_id", "i", "j", rnd(F.col("raf")).alias("raf"), rnd(F.col("rafs")).alias("rafs"))


def joint_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pp = P.joint(P.joint_counts(SOURCES["orders"](spark, sf_dir)))
    return pp.select("aln_id", "i", "j", "nseff", "ngap", *(rnd(F.col("p")[c], 9).alias(f"p{c}") for c in range(16)))


def col_marginals(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = P.marginals(P.joint(P.joint_counts(SOURCES["events"](spark, sf_dir))))
    return m.select("aln_id", "col", *(rnd(F.col("m")[x], 9).alias(f"m{x}") for x in range(4)))


def col_singles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.singles(SOURCES["events"](spark, sf_dir)).select("aln_id", "col", F.col("x").cast("int").alias("x"), rnd(F.col("p"), 9).alias("p"))


QUERIES = {"gtest_apc": gtest_apc, "cov_gt_wc": cov_gt_wc, "cov_ccf": cov_ccf, "cov_raf": cov_raf, "joint_probs": joint_probs, "col_marginals": col_marginals, "col_singles": col_singles}
QUERIES |= {f"cov_{s}": partial(cov_stat, stat=s) for s in P.STATS}
QUERIES |= {f"cov_{s}_events": partial(cov_stat, stat=s, source="events") for s in ("gt", "mig")}


def _stat_sql(stat: str, source: str) -> str:
    return f"""WITH {O.CELLS[source]}, {O.PROBS}, {O.stat(stat, "t16", "s16")}, {O.stat(stat, "t2", "s2")}, {O.means("s16")}
SELECT corr.aln_id, corr.i, corr.j, {O.r("corr.v", "c16")}, {O.r("s2.v", "c2")}, {O.r("CASE WHEN g <> 0 THEN corr.v - ri * rj / g ELSE 0 END", "c16_apc")}, {O.r("corr.v - (ri + rj - g)", "c16_asc")}
FROM corr JOIN s2 ON s2.aln_id = corr.aln_id AND s2.i = corr.i AND s2.j = corr.j"""


ORACLE = {
    "gtest_apc": f"""WITH {O.CELLS["orders"]}, {O.PROBS}, {O.stat("gt", "t16", "s16")}, {O.means("s16")}
SELECT aln_id, i, j, nseff, {O.r("v", "gt")}, {O.r("CASE WHEN g <> 0 THEN v - ri * rj / g ELSE 0 END", "gtp")} FROM corr""",
    "cov_gt_wc": f"""WITH {O.CELLS["embeddings"]}, {O.PROBS}, {O.stat("gt", "t16", "s", "x + y IN (3, 5)")} SELECT aln_id, i, j, {O.r("v", "gt_wc")} FROM s""",
    "cov_ccf": f"""WITH {O.CELLS["embeddings"]}, {O.PROBS}, mv AS (SELECT aln_id, x, s / sum(s) OVER (PARTITION BY aln_id) AS mx FROM (SELECT aln_id, x, sum(m) AS s FROM pm GROUP BY 1, 2)),
t AS (SELECT pp.aln_id, pp.i, pp.j, (nseff * a.m - u.mx) * (nseff * b.m - v.mx) AS d FROM pp JOIN pm a ON a.aln_id = pp.aln_id AND a.col = pp.i AND a.x = pp.x JOIN pm b ON b.aln_id = pp.aln_id AND b.col = pp.j AND b.x = pp.y
 JOIN mv u ON u.aln_id = pp.aln_id AND u.x = pp.x JOIN mv v ON v.aln_id = pp.aln_id AND v.x = pp.y)
SELECT aln_id, i, j, {O.r("sqrt(sum(d * d))", "ccf", 5)} FROM t GROUP BY 1, 2, 3""",
    "cov_raf": f"""WITH {O.CELLS["events"]}, {O.PROBS}, al AS (SELECT aln_id, i, j, x, y, c, n FROM pp WHERE x + y IN (3, 5)),
ch AS (SELECT a.aln_id, a.i, a.j, sum(a.c * b.c * (CASE WHEN a.x <> b.x THEN 1 ELSE 0 END + CASE WHEN a.y <> b.y THEN 1 ELSE 0 END)) / 2.0 AS ch FROM al a JOIN al b USING (aln_id, i, j) GROUP BY ALL),
g AS (SELECT aln_id, i, j, max(n) AS n, sum(c) AS good FROM al GROUP BY ALL),
raf AS (SELECT aln_id, i, j, CASE WHEN n > 1 THEN 2 * ch / (n * (n - 1)) ELSE 0 END - (n - good) / n AS raf FROM ch JOIN g USING (aln_id, i, j))
SELECT s.aln_id, s.i, s.j, {O.r("s.raf", "raf")}, {O.r("(coalesce(o.raf, 0) + 2 * s.raf + CASE WHEN s.i < s.j - 2 THEN coalesce(n.raf, 0) ELSE 0 END) / 4", "rafs")}
FROM raf s LEFT JOIN raf o ON o.aln_id = s.aln_id AND o.i = s.i - 1 AND o.j = s.j + 1 LEFT JOIN raf n ON n.aln_id = s.aln_id AND n.i = s.i + 1 AND n.j = s.j - 1""",
    "joint_probs": f"""WITH {O.CELLS["orders"]}, {O.PROBS} SELECT aln_id, i, j, max(nseff) AS nseff, max(n) - max(nseff) AS ngap, {", ".join(O.r(f"max(CASE WHEN x = {c // 4} AND y = {c % 4} THEN p END)", f"p{c}", 9) for c in range(16))} FROM pp GROUP BY 1, 2, 3""",
    "col_marginals": f"""WITH {O.CELLS["events"]}, {O.PROBS} SELECT aln_id, col, {", ".join(O.r(f"max(CASE WHEN x = {x} THEN m END)", f"m{x}", 9) for x in range(4))} FROM pm GROUP BY 1, 2""",
    "col_singles": f"""WITH {O.CELLS["events"]}, {O.GRID}, u AS (SELECT CAST(x AS INTEGER) AS x FROM range(5) t(x)),
k AS (SELECT aln_id, col, CASE WHEN res < 4 THEN res ELSE 4 END AS x, count(*) AS c FROM cells GROUP BY ALL),
q AS (SELECT cols.aln_id, cols.col, u.x, n, coalesce(k.c, 0) AS c, sum(coalesce(k.c, 0)) FILTER (WHERE u.x < 4) OVER (PARTITION BY cols.aln_id, cols.col) AS canon FROM cols CROSS JOIN u JOIN ns ON ns.aln_id = cols.aln_id LEFT JOIN k ON k.aln_id = cols.aln_id AND k.col = cols.col AND k.x = u.x)
SELECT aln_id, col, x, {O.r("(CASE WHEN x < 4 THEN c ELSE n - canon END + 1e-5) / (n + 5e-5)", "p", 9)} FROM q""",
}
ORACLE |= {f"cov_{s}": _stat_sql(s, "embeddings") for s in P.STATS}
ORACLE |= {f"cov_{s}_events": _stat_sql(s, "events") for s in ("gt", "mig")}
