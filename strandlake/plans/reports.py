"""Report queries, text round trips, and the numpy operators on the vectors' alignments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators import filters as X
from strandlake.operators import models as M
from strandlake.operators import pairs as P
from strandlake.operators import pseudo
from strandlake.operators import reports as R
from strandlake.operators import significance as S
from strandlake.operators import structure as T
from strandlake.operators import trees
from strandlake.plans import oracle as O
from strandlake.plans.alignments import _IDENT, _ROWS, rows
from strandlake.plans.covariation import rnd
from strandlake.plans.significance import _E, _SP, _evalues
from strandlake.plans.structure import _CT, _ct
from strandlake.sources import alignments as A
from strandlake.storage import new_path
from strandlake.tables import once, table


def family_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = S.summary(_evalues(spark, sf_dir), 5.0).withColumnRenamed("aln_id", "family").withColumn("power", F.col("true") / 100.0)
    return R.rank_families(s).select("family", R.two_decimals(F.col("sen")).cast("double").alias("sen"), R.two_decimals(F.col("ppv")).cast("double").alias("ppv"), "band", "rank")


def motif_stats(spark, sf_dir) -> DataFrame:
    """Helices by molecule type and size, with totals."""
    kind = F.coalesce(F.upper(F.trim("msa_type")), F.lit("?"))
    a = once(table(spark, sf_dir, "alignments").withColumn("kind", kind), "aln_id", "kind")
    return R.motif_stats(T.helices(_ct(spark, sf_dir), 2).join(a, "aln_id"))


def apparent_covariation(spark, sf_dir) -> DataFrame:
    return R.apparent_covariation(P.joint_counts(pseudo.events_cells(spark, sf_dir)), 0.75)


def clipped_hits(spark, sf_dir) -> DataFrame:
    h = once(table(spark, sf_dir, "domain_hits"), "hit_id", "sqfrom", "sqto")
    return R.clip_hits(h, 100, 500).select("hit_id", "cfrom", "cto")


def score_histogram(spark, sf_dir) -> DataFrame:
    h = once(table(spark, sf_dir, "domain_hits").withColumn("sc", F.nanvl("sc", F.lit(None).cast("double"))), "hit_id", "sc")
    r = R.value_histogram(h.withColumn("x", F.col("sc") / 100), "x", 10, 3.0)
    return r.select("bin", "n", rnd(F.col("upto")).alias("upto"))


def length_regression(spark, sf_dir) -> DataFrame:
    """Score on hit length below 300, by query."""
    h = once(table(spark, sf_dir, "domain_hits").withColumn("sc", F.nanvl("sc", F.lit(None).cast("double"))), "hit_id", "queryname", "sqfrom", "sqto", "sc").where("queryname IS NOT NULL AND sc IS NOT NULL AND sqfrom IS NOT NULL AND sqto IS NOT NULL")
    r = R.censored_regression(h.withColumn("len", (F.abs(F.col("sqto") - F.col("sqfrom")) + 1).cast("double")), "queryname", "len", "sc", 300.0)
    return r.select("queryname", rnd(F.col("slope"), 4).alias("slope"), "n")


def structure_comparison(spark, sf_dir) -> DataFrame:
    """Consensus structures next to the same without the pairs closer than 12 columns."""
    ct = _ct(spark, sf_dir)
    return R.compare_structures(ct, ct.where("j - i >= 12"))


def fasta_again(spark, sf_dir) -> DataFrame:
    """All rows written as FASTA and read back."""
    path = new_path(spark, "fasta")
    A.write_fasta(rows(spark, sf_dir).select(F.col("seq_id").cast("string").alias("name"), F.col("aseq").alias("seq")), path)
    return A.read_fasta(spark, path).select(F.col("name").cast("long").alias("seq_id"), F.col("seq").alias("aseq"))


def stockholm_again(spark, sf_dir) -> DataFrame:
    """All alignments written as Stockholm records and read back."""
    path = new_path(spark, "stockholm")
    d = rows(spark, sf_dir, "seq_idx").withColumn("sqname", F.col("seq_id").cast("string"))
    a = once(table(spark, sf_dir, "alignments"), "aln_id", "ss_cons")
    A.write_stockholm(d.select("aln_id", F.coalesce("seq_idx", F.lit(0)).alias("seq_idx"), "sqname", "aseq"), a, path)
    s, _ = A.read_stockholm(spark, path)
    return s.select("aln_id", F.split("sqname", r"\.")[0].cast("long").alias("seq_id"), "aseq")


def _strings(spark, sf_dir) -> DataFrame:
    """The vectors' alignments as strings."""
    c = pseudo.embeddings_cells(spark, sf_dir)
    ch = F.array_sort(F.collect_list(F.struct("col", F.substring(F.lit("ACGU"), F.col("res") + 1, F.lit(1)).alias("s"))))
    return c.groupBy("aln_id", "seq").agg(F.array_join(F.transform(ch, lambda x: x["s"]), "").alias("aseq")).withColumnRenamed("seq", "seq_id")


def tree_changes(spark, sf_dir) -> DataFrame:
    """Least substitutions of every column on a UPGMA tree."""
    return trees.column_changes(_strings(spark, sf_dir))


def tree_null(spark, sf_dir) -> DataFrame:
    """Two nulls with the tree's substitutions replayed."""
    return trees.null_rows(_strings(spark, sf_dir), 2)


def distinct_rows(spark, sf_dir) -> DataFrame:
    """Rows kept by a greedy identity filter of two fifths."""
    return trees.max_identity(_strings(spark, sf_dir), 0.4)


def identity_clusters(spark, sf_dir) -> DataFrame:
    c = pseudo.events_cells(spark, sf_dir)
    return trees.clusters(X.pair_identity(c), c.select("aln_id", "seq").distinct(), 0.5)


def joint_substitutions(spark, sf_dir) -> DataFrame:
    return M.joint_substitutions(_strings(spark, sf_dir), 0.4).select("a", "b", "n")


def potts_scores(spark, sf_dir) -> DataFrame:
    d = M.potts_scores(_strings(spark, sf_dir))
    return d.select("aln_id", "i", "j", rnd(F.col("ptf"), 4).alias("ptf"), rnd(F.col("pta"), 4).alias("pta"))


def simulated(spark, sf_dir) -> DataFrame:
    """Alignments with the sizes of the declared ones, one row or column where none is declared."""
    a = once(table(spark, sf_dir, "alignments"), "aln_id", "nseq", "alen")
    size = lambda c: F.greatest(F.coalesce(c, F.lit(1)), F.lit(1)).alias(c)
    return M.simulate(a.select("aln_id", size("nseq"), size("alen"), F.lit(0.2).alias("mean_branch")))


QUERIES = {f.__name__: f for f in (family_ranks, motif_stats, apparent_covariation, clipped_hits, score_histogram, length_regression, structure_comparison, fasta_again, stockholm_again, tree_changes, tree_null, distinct_rows, identity_clusters, joint_substitutions, potts_scores, simulated)}

_HITS = "h AS (SELECT hit_id, min(queryname) AS queryname, min(sqfrom) AS sqfrom, min(sqto) AS sqto, min(CASE WHEN isnan(sc) THEN NULL ELSE sc END) AS sc FROM domain_hits WHERE hit_id IS NOT NULL GROUP BY 1)"
_HELIX = _CT + """, l AS (SELECT *, lag(i) OVER w AS pi, lag(j) OVER w AS pj FROM ct WINDOW w AS (PARTITION BY aln_id, layer ORDER BY i)),
hx AS (SELECT *, sum(CASE WHEN pi IS NULL OR pj <= j OR i - pi - 1 + pj - j - 1 > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY aln_id, layer ORDER BY i) AS helix FROM l),
he AS (SELECT aln_id, layer, helix, count(*) AS n FROM hx GROUP BY 1, 2, 3), ty AS (SELECT aln_id, min(coalesce(upper(trim(msa_type)), '?')) AS kind FROM alignments WHERE aln_id IS NOT NULL GROUP BY 1)"""
ORACLE = {
    "family_ranks": _E + f""", g AS (SELECT aln_id AS family, count(*) FILTER (WHERE evalue < 5) AS found, count(*) FILTER (WHERE is_bp) AS "true", count(*) FILTER (WHERE is_bp AND evalue < 5) AS tp FROM ev GROUP BY 1), q AS (SELECT *, {_SP} FROM g)
SELECT family, CAST(floor(sen * 100 + 1e-9) / 100 AS DOUBLE) AS sen, CAST(floor(ppv * 100 + 1e-9) / 100 AS DOUBLE) AS ppv, CASE WHEN ppv > 95 THEN 'high' WHEN ppv > 50 THEN 'middle' ELSE 'low' END AS band, CAST(row_number() OVER (ORDER BY sen DESC, "true" DESC, family) AS INTEGER) AS rank FROM q""",
    "motif_stats": _HELIX + """, k AS (SELECT he.aln_id, kind, n, CASE WHEN n < 4 THEN 'short' WHEN n < 6 THEN 'middle' ELSE 'long' END AS size FROM he JOIN ty ON ty.aln_id = he.aln_id)
SELECT coalesce(kind, 'all') AS kind, coalesce(size, 'all') AS size, count(*) AS n_helices, count(DISTINCT aln_id) AS n_families, CAST(sum(n) AS BIGINT) AS n_pairs FROM k GROUP BY ROLLUP (kind, size)""",
    "apparent_covariation": f"""WITH {O.CELLS["events"]}, {O.PROBS}, l AS (SELECT aln_id, i, j, x AS k, sum(c) AS c FROM pp GROUP BY ALL), r AS (SELECT aln_id, i, j, y AS k, sum(c) AS c FROM pp GROUP BY ALL),
tl AS (SELECT aln_id, i, j, sum(c) AS n, max(c) AS m, arg_max(k, (c, -k)) AS t FROM l GROUP BY ALL), tr AS (SELECT aln_id, i, j, max(c) AS m, arg_max(k, (c, -k)) AS t FROM r GROUP BY ALL),
b AS (SELECT aln_id, i, j, sum(c) AS paired FROM pp WHERE x + y IN (3, 5) GROUP BY ALL),
k AS (SELECT tl.aln_id, tl.i, tl.j, paired, tl.t AS t1, tr.t AS t2 FROM tl JOIN tr USING (aln_id, i, j) JOIN b USING (aln_id, i, j) WHERE n > 0 AND paired >= 0.25 * n AND n - tl.m >= 1 AND n - tr.m >= 1),
e AS (SELECT k.aln_id, k.i, k.j, paired, t1 AS t, l.k AS k, l.c FROM k JOIN l USING (aln_id, i, j) UNION ALL SELECT k.aln_id, k.i, k.j, paired, t2, r.k, r.c FROM k JOIN r USING (aln_id, i, j))
SELECT aln_id, i, j, CAST(max(paired) AS DOUBLE) AS paired, CAST(sum(CASE WHEN abs(k - t) = 2 THEN c ELSE 0 END) AS DOUBLE) AS ts, CAST(sum(CASE WHEN abs(k - t) IN (1, 3) THEN c ELSE 0 END) AS DOUBLE) AS tv,
 CAST(sum(CASE WHEN t = 2 AND k = 0 THEN c ELSE 0 END) AS DOUBLE) AS a_g, CAST(sum(CASE WHEN t = 1 AND k = 3 THEN c ELSE 0 END) AS DOUBLE) AS u_c FROM e GROUP BY 1, 2, 3""",
    "clipped_hits": f"WITH {_HITS} SELECT hit_id, greatest(least(sqfrom, sqto), 100) AS cfrom, least(greatest(sqfrom, sqto), 500) AS cto FROM h WHERE greatest(sqfrom, sqto) >= 100 AND least(sqfrom, sqto) <= 500",
    "score_histogram": f"""WITH {_HITS}, b AS (SELECT CAST(least(greatest(floor(sc / 100 * 10), 0), 29) AS INTEGER) AS bin, count(*) AS n FROM h WHERE sc IS NOT NULL GROUP BY 1) SELECT bin, n, {O.r("sum(n) OVER (ORDER BY bin) / sum(n) OVER ()", "upto")} FROM b""",
    "length_regression": f"""WITH {_HITS}, l AS (SELECT queryname, CAST(abs(sqto - sqfrom) + 1 AS DOUBLE) AS len, sc FROM h WHERE queryname IS NOT NULL AND sc IS NOT NULL AND sqfrom IS NOT NULL AND sqto IS NOT NULL), s AS (SELECT * FROM l WHERE len < 300)
SELECT queryname, {O.r("CASE WHEN count(*) > 2 AND min(len) < max(len) THEN regr_slope(sc, len) ELSE 0 END", "slope", 4)}, count(*) AS n FROM s GROUP BY 1""",
    "structure_comparison": _CT + """, g AS (SELECT aln_id, count(*) FILTER (WHERE j - i < 12) AS only_a, CAST(0 AS BIGINT) AS only_b, count(*) FILTER (WHERE j - i >= 12) AS "both" FROM ct GROUP BY 1) SELECT *, CASE WHEN only_a = 0 THEN 'equal' ELSE 'worse' END AS verdict FROM g""",
    "fasta_again": f"WITH {_ROWS} SELECT seq_id, aseq FROM rows WHERE aseq IS NOT NULL",
    "stockholm_again": f"WITH {_ROWS} SELECT aln_id, seq_id, aseq FROM rows WHERE length(aseq) > 0",
    "identity_clusters": f"""WITH RECURSIVE {O.CELLS["events"]}, {_IDENT}, e AS (SELECT aln_id, a AS u, b AS v FROM ident WHERE same / m >= 0.5 UNION ALL SELECT aln_id, b, a FROM ident WHERE same / m >= 0.5),
r AS (SELECT DISTINCT aln_id, seq, seq AS c FROM cells UNION SELECT r.aln_id, r.seq, e.v FROM r JOIN e ON e.aln_id = r.aln_id AND e.u = r.c) SELECT aln_id, seq, min(c) AS cluster FROM r GROUP BY 1, 2""",
    "distinct_rows": f"""WITH RECURSIVE {O.CELLS["embeddings"]}, {_IDENT}, nb AS (SELECT aln_id, b, list(a) AS l FROM ident WHERE same / m >= CAST(0.4 AS DOUBLE) GROUP BY 1, 2), s AS (SELECT aln_id, seq, row_number() OVER (PARTITION BY aln_id ORDER BY seq) AS k FROM (SELECT DISTINCT aln_id, seq FROM cells)),
g AS (SELECT DISTINCT aln_id, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS kept FROM s UNION ALL SELECT g.aln_id, s.k, CASE WHEN list_has_any(kept, coalesce(nb.l, CAST([] AS BIGINT[]))) THEN kept ELSE list_append(kept, s.seq) END FROM g JOIN s ON s.aln_id = g.aln_id AND s.k = g.k + 1 LEFT JOIN nb ON nb.aln_id = s.aln_id AND nb.b = s.seq)
SELECT aln_id, unnest(kept) AS seq_id FROM (SELECT aln_id, arg_max(kept, k) AS kept FROM g GROUP BY 1)""",
    "joint_substitutions": f"""WITH {O.CELLS["embeddings"]}, {_IDENT}, p AS (SELECT aln_id, a, b FROM ident WHERE same / m >= CAST(0.4 AS DOUBLE)), o AS (SELECT c.res AS a, d.res AS b, count(*) AS n FROM p JOIN cells c ON c.aln_id = p.aln_id AND c.seq = p.a JOIN cells d ON d.aln_id = p.aln_id AND d.seq = p.b AND d.col = c.col GROUP BY 1, 2)
SELECT CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, CAST(sum(n) / 2 AS DOUBLE) AS n FROM (SELECT a, b, n FROM o UNION ALL SELECT b, a, n FROM o) GROUP BY 1, 2""",
}
