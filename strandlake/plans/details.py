"""Queries on grammars, trees and real alignments, and the smaller steps between the main ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators import analysis as A
from strandlake.operators import contacts as C
from strandlake.operators import filters as X
from strandlake.operators import pairs as P
from strandlake.operators import power as PW
from strandlake.operators import pseudo
from strandlake.operators import reports as R
from strandlake.operators import significance as S
from strandlake.operators import structure as T
from strandlake.operators import trees
from strandlake.plans import oracle as O
from strandlake.plans.alignments import _IDENT, _LONG, _ROWS, rows
from strandlake.plans.alignments import ORACLE as ALN
from strandlake.plans.covariation import _pp, _ppm, rnd
from strandlake.plans.significance import _BR, _E, _SP, CURVE, _branches, _evalues
from strandlake.plans.structure import _CT, _ct
from strandlake.sources import tables as ST
from strandlake.storage import materialize, new_path
from strandlake.tables import once, table

# ---- real alignments ---------------------------------------------------------------------------


def _covarying(spark: SparkSession, sf_dir: str, **params) -> DataFrame:
    ss = once(table(spark, sf_dir, "alignments"), "aln_id", "ss_cons").withColumnRenamed("ss_cons", "ss")
    return A.covarying(rows(spark, sf_dir), ss, CURVE, **params)


def covarying_pairs(spark, sf_dir) -> DataFrame:
    """Significant column pairs of every alignment of seqs against nulls on its tree, and its base pairs."""
    d = _covarying(spark, sf_dir)
    return d.select("aln_id", "i", "j", "is_bp", *(rnd(F.col(c), 4).alias(c) for c in ("score", "pval", "evalue")), "nsubs", "power", rnd(F.col("canonical"), 4).alias("canonical"))


def power_report(spark, sf_dir) -> DataFrame:
    """Expected and observed covarying base pairs of every alignment of seqs."""
    s = PW.power_summary(_covarying(spark, sf_dir, bp_only=True))
    return s.select("aln_id", "n_bp", *(rnd(F.col(c)).alias(c) for c in ("expected", "sd", "mean_subs")), "observed")


def tree_subs(spark, sf_dir) -> DataFrame:
    """Substitutions of every column of seqs on its alignment's tree."""
    return trees.column_subs(rows(spark, sf_dir))


def tree_edges(spark, sf_dir) -> DataFrame:
    return trees.build(rows(spark, sf_dir)).withColumn("blen", rnd(F.col("blen")))


def tree_nodes(spark, sf_dir) -> DataFrame:
    """Leaves and height of every clade of the vectors' trees."""
    from strandlake.plans.reports import _strings

    e = trees.scale_branches(trees.build(_strings(spark, sf_dir)), "average", 1.0)
    return trees.node_times(trees.clades(e)).withColumn("height", rnd(F.col("height"), 5))


def ancestral_rows(spark, sf_dir) -> DataFrame:
    """Every node of the trees of seqs with its residues."""
    return trees.ancestors(rows(spark, sf_dir)).select("aln_id", "node", "parent", "seq_id", "aseq")


# ---- grammars ----------------------------------------------------------------------------------


def _reference_rows(spark, sf_dir) -> DataFrame:
    """(seq_id, aseq): the row that stands for each alignment in folding, its first one with residues."""
    first = rows(spark, sf_dir).where("aseq rlike '[A-Za-z]'").groupBy("aln_id").agg(F.min(F.struct("seq_id", "aseq")).alias("r"))
    tasks = 4 * spark.sparkContext.defaultParallelism  # few bytes, cubic work
    return first.select("r.*").repartition(tasks, "seq_id")


def inside_g5(spark, sf_dir) -> DataFrame:
    """Log probability of every alignment's reference row under G5 with even emissions."""
    return T.inside(_reference_rows(spark, sf_dir), "g5").select("seq_id", rnd(F.col("logp"), 5).alias("logp"))


def inside_g6(spark, sf_dir) -> DataFrame:
    return T.inside(_reference_rows(spark, sf_dir), "g6").select("seq_id", rnd(F.col("logp"), 5).alias("logp"))


def inside_g6x(spark, sf_dir) -> DataFrame:
    return T.inside(_reference_rows(spark, sf_dir), "g6x").select("seq_id", rnd(F.col("logp"), 5).alias("logp"))


def folded(spark, sf_dir) -> DataFrame:
    """Pairs of greatest expected accuracy of every alignment's reference row."""
    return T.fold(_reference_rows(spark, sf_dir))


# ---- steps -------------------------------------------------------------------------------------


def gt_shifted(spark, sf_dir) -> DataFrame:
    d = materialize(_ppm(spark, sf_dir, "embeddings").select("aln_id", "i", "j", P.covariation("gt").alias("gt")), "scores")
    return P.correct(d, "gt", shift=True).select("aln_id", "i", "j", rnd(F.col("gt_apc")).alias("apc"), rnd(F.col("gt_asc")).alias("asc"))


def raf_corrected(spark, sf_dir) -> DataFrame:
    r = materialize(P.raf(P.joint_counts(pseudo.events_cells(spark, sf_dir))), "raf")
    return P.correct(r, "raf").select("aln_id", "i", "j", rnd(F.col("raf_apc")).alias("apc"), rnd(F.col("raf_asc")).alias("asc"))


def ccf_corrected(spark, sf_dir) -> DataFrame:
    d = materialize(P.ccf(_pp(spark, sf_dir, "embeddings")), "ccf")
    return P.correct(d, "ccf").select("aln_id", "i", "j", rnd(F.col("ccf_apc"), 4).alias("apc"))


def joint_gap_probs(spark, sf_dir) -> DataFrame:
    c = pseudo.events_cells(spark, sf_dir)
    return P.joint_with_gaps(P.joint_counts(c), c).select("aln_id", "i", "j", *(rnd(F.col("p")[k], 9).alias(f"p{k}") for k in range(25)))


def pair_composition(spark, sf_dir) -> DataFrame:
    return P.composition(P.joint_counts(pseudo.events_cells(spark, sf_dir))).select("aln_id", "i", "j", *(rnd(F.col(c)).alias(c) for c in ("wcf", "wobble", "noncan", "nseff_pct")))


def recoded_gaps(spark, sf_dir) -> DataFrame:
    return rows(spark, sf_dir).where("aseq IS NOT NULL").select("seq_id", X.recode(F.col("aseq"), "gap").alias("aseq"))


def paired_composition(spark, sf_dir) -> DataFrame:
    return X.paired_composition(rows(spark, sf_dir), _ct(spark, sf_dir))


def same_composition(spark, sf_dir) -> DataFrame:
    """Alignments before and after their fragments are dropped."""
    r = rows(spark, sf_dir)
    return X.same_composition(r, X.whole_rows(r, 0.7))


def single_rows(spark, sf_dir) -> DataFrame:
    return X.without_gaps_if_single(rows(spark, sf_dir)).where("aseq IS NOT NULL").select("seq_id", "aseq")


def ordered_rows(spark, sf_dir) -> DataFrame:
    """Rows by falling number of characters."""
    return X.reordered(rows(spark, sf_dir), F.desc(F.coalesce(F.length("aseq"), F.lit(0)))).select("aln_id", "seq_id", "seq_idx")


def window_columns(spark, sf_dir) -> DataFrame:
    r = rows(spark, sf_dir)
    return X.window_columns(X.keep_columns(r, 0.5), X.windows(r.groupBy("aln_id").agg(F.max(F.length("aseq")).alias("alen"))))


def homology_counts(spark, sf_dir) -> DataFrame:
    """Rows as delivered against the same in upper case."""
    r = rows(spark, sf_dir).select("aln_id", "seq_id", "aseq")
    return X.homology_counts(r, r.withColumn("aseq", F.upper("aseq")))


def cluster_weights(spark, sf_dir) -> DataFrame:
    c = pseudo.events_cells(spark, sf_dir)
    k = trees.clusters(X.pair_identity(c, 0.62), c.select("aln_id", "seq").distinct(), 0.62)
    return X.cluster_weights(k).withColumn("w", rnd(F.col("w")))


def largest_clusters(spark, sf_dir) -> DataFrame:
    c = pseudo.events_cells(spark, sf_dir)
    return trees.min_identity(X.pair_identity(c, 0.5), c.select("aln_id", "seq").distinct(), 0.5)


def repaired_pairs(spark, sf_dir) -> DataFrame:
    """Base pairs in the places left by the gap filter."""
    return T.repair_pairs(_ct(spark, sf_dir), X.keep_columns(rows(spark, sf_dir), 0.5))


def excluded_pairs(spark, sf_dir) -> DataFrame:
    return T.excluded(_ct(spark, sf_dir).select("aln_id", "layer", "i", "j"))


def motif_places(spark, sf_dir) -> DataFrame:
    """Places of three segments of degenerate letters in the residues of all rows."""
    r = rows(spark, sf_dir).where("aseq IS NOT NULL").select("seq_id", F.translate(F.upper(F.regexp_replace("aseq", "[^A-Za-z]", "")), "T", "U").alias("res"))
    return ST.scan_segments(r, SEGMENTS)


SEGMENTS = [("tetra", "GNRA"), ("bulge", "CUYG"), ("turn", "UGAN")]


def power_types(spark, sf_dir) -> DataFrame:
    """The kind of substitutions each pair's power rests on, where double ones count only if there are any, and join ones from three on."""
    d = PW.pair_subs(_branches(spark, sf_dir))
    d = d.withColumn("d", F.when(F.col("double") > 0, F.col("double"))).withColumn("e", F.when(F.col("join") > 2, F.col("join")))
    return d.select("aln_id", "i", "j", PW.power_type(F.lit(1), F.col("e"), F.col("d")).alias("kind"))


def prepared_pairs(spark, sf_dir) -> DataFrame:
    return PW.prepared(_evalues(spark, sf_dir)).select("aln_id", "i", "j", "score", rnd(F.col("evalue")).alias("evalue"))


def power_curve(spark, sf_dir) -> DataFrame:
    """Share of pairs with E below 0.05 by distance, for which substitutions stand."""
    c = PW.power_curve(_evalues(spark, sf_dir).withColumn("nsubs", F.col("j") - F.col("i")), 4)
    return c.select(F.col("subs").cast("long").alias("subs"), "n", "covarying", rnd(F.col("prob")).alias("prob"))


def family_segments(spark, sf_dir) -> DataFrame:
    s = S.summary(_evalues(spark, sf_dir), 5.0).withColumnRenamed("aln_id", "family").withColumn("power", F.pmod("found", F.lit(3)).cast("double")).withColumn("expected", F.col("true") / 16)
    return R.segments(s).select("family", "segment")


def random_baseline(spark, sf_dir) -> DataFrame:
    w = rows(spark, sf_dir).groupBy("aln_id").agg(F.max(F.length("aseq")).alias("alen"))
    return R.random_pairs(w, 20, 5)


def score_split(spark, sf_dir) -> DataFrame:
    ev = _evalues(spark, sf_dir).withColumn("mark", F.when(F.col("is_bp"), "*").otherwise("~"))
    return R.score_split(ev).select("kind", "n", *(rnd(F.col(c), 4).alias(c) for c in ("mean", "sd", "top")))


def score_median(spark, sf_dir) -> DataFrame:
    h = once(table(spark, sf_dir, "domain_hits").withColumn("sc", F.nanvl("sc", F.lit(None).cast("double"))), "hit_id", "sc").withColumn("x", F.col("sc") / 100)
    return R.histogram_median(R.value_histogram(h, "x", 10, 3.0), 10)


def structure_summary(spark, sf_dir) -> DataFrame:
    ct = _ct(spark, sf_dir)
    s = R.pair_summary(T.helices(ct, 2), ct)
    return s.withColumn("mean_pairs", rnd(F.col("mean_pairs"))).withColumn("sd_pairs", rnd(F.col("sd_pairs")))


def contacts_between(spark, sf_dir) -> DataFrame:
    """Vectors as atoms in three dimensions, ten atoms a residue, labels as chains: residues of two chains that touch."""
    e = table(spark, sf_dir, "embeddings")
    at = [F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate("xyz")]
    return C.between_chains(e.select(F.col("label").alias("chain"), F.floor(F.col("vec_id") / 10).cast("int").alias("resnum"), *at), 0.04).withColumn("dist", rnd(F.col("dist"), 7))


def hits_again(spark, sf_dir) -> DataFrame:
    """Significant pairs written as a sorted report and read back."""
    path = new_path(spark, "report")
    h = S.hits(_evalues(spark, sf_dir), 5.0).select("aln_id", F.when(F.col("is_bp"), "*").otherwise(" ").alias("mark"), F.col("i").alias("left_pos"), F.col("j").alias("right_pos"), "score", "evalue")
    ST.write_hits(h, path)
    return ST.read_hits(spark, path).select("family", F.trim("mark").alias("mark"), "left_pos", "right_pos", rnd(F.col("score")).alias("score"), rnd(F.col("evalue"), 4).alias("evalue"))


def whole_motif(spark, sf_dir) -> DataFrame:
    """Hairpin loops of a helix end: a stretch GNRA directly inside the innermost pair of a helix, by alignment and helix, in any row."""
    h = T.helices(_ct(spark, sf_dir), 2).where("j_in - i_in = 5")
    r = rows(spark, sf_dir).join(h.select("aln_id", "layer", "helix", "i_in"), "aln_id")
    loop = F.translate(F.upper(F.expr("substring(aseq, i_in + 1, 4)")), "T", "U")
    return r.where(loop.rlike("^G[ACGU][AG]A$")).groupBy("aln_id", "layer", "helix").agg(F.count(F.lit(1)).alias("n_rows"))


NAMES = (covarying_pairs, power_report, tree_subs, tree_edges, tree_nodes, ancestral_rows, inside_g5, inside_g6, inside_g6x, folded, gt_shifted, raf_corrected, ccf_corrected, joint_gap_probs, pair_composition, recoded_gaps, paired_composition, same_composition, single_rows, ordered_rows, window_columns, homology_counts, cluster_weights, largest_clusters, repaired_pairs, excluded_pairs, motif_places, power_types, prepared_pairs, power_curve, family_segments, random_baseline, score_split, score_median, structure_summary, contacts_between, hits_again, whole_motif)
QUERIES = {f.__name__: f for f in NAMES}

_LEN = "w AS (SELECT seq_id, length(regexp_replace(aseq, '[^A-Za-z]', '', 'g')) AS n, row_number() OVER (PARTITION BY aln_id ORDER BY seq_id) AS rn FROM rows WHERE regexp_matches(aseq, '[A-Za-z]') QUALIFY rn = 1)"
_G6 = """l(n, lx, sx, fx) AS (SELECT 1, [{l1}], [{s1}], [{f1}] UNION ALL SELECT n + 1, list_append(lx, {ln}), list_append(sx, {sn}), list_append(fx, {fn}) FROM
 (SELECT *, CASE WHEN n >= 2 THEN {lp} * fx[n - 1] ELSE 0 END{lx} AS nl FROM l WHERE n < 4000) z, LATERAL (SELECT coalesce(list_sum(list_transform(range(1, n + 1), lambda k: lx[k] * sx[n + 1 - k])), 0){tail} AS nsplit) q)"""
_CL = f"""WITH RECURSIVE {O.CELLS["events"]}, {_IDENT}, e AS (SELECT aln_id, a AS u, b AS v FROM ident WHERE same / m >= CAST(@ AS DOUBLE) UNION ALL SELECT aln_id, b, a FROM ident WHERE same / m >= CAST(@ AS DOUBLE)),
r AS (SELECT DISTINCT aln_id, seq, seq AS c FROM cells UNION SELECT r.aln_id, r.seq, e.v FROM r JOIN e ON e.aln_id = r.aln_id AND e.u = r.c), cl AS (SELECT aln_id, seq, min(c) AS cluster FROM r GROUP BY 1, 2)"""
_RAF = f"""WITH {O.CELLS["events"]}, {O.PROBS}, al AS (SELECT aln_id, i, j, x, y, c, n FROM pp WHERE x + y IN (3, 5)),
ch AS (SELECT a.aln_id, a.i, a.j, sum(a.c * b.c * (CASE WHEN a.x <> b.x THEN 1 ELSE 0 END + CASE WHEN a.y <> b.y THEN 1 ELSE 0 END)) / 2.0 AS ch FROM al a JOIN al b USING (aln_id, i, j) GROUP BY ALL),
g AS (SELECT aln_id, i, j, max(n) AS n, sum(c) AS good FROM al GROUP BY ALL),
s16 AS (SELECT aln_id, i, j, n AS nseff, CAST(CASE WHEN n > 1 THEN 2 * ch / (n * (n - 1)) ELSE 0 END - (n - good) / n AS DOUBLE) AS v FROM ch JOIN g USING (aln_id, i, j)), {O.means("s16")}"""
_HLX = _CT + """, l AS (SELECT *, lag(i) OVER w AS pi, lag(j) OVER w AS pj FROM ct WINDOW w AS (PARTITION BY aln_id, layer ORDER BY i)),
hx AS (SELECT *, sum(CASE WHEN pi IS NULL OR pj <= j OR i - pi - 1 + pj - j - 1 > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY aln_id, layer ORDER BY i) AS helix FROM l),
he AS (SELECT aln_id, layer, helix, count(*) AS n, max(i) AS i_in, min(j) AS j_in FROM hx GROUP BY 1, 2, 3)"""
_R = _ROWS + ", "
_RES = "replace(upper(regexp_replace(aseq, '[^A-Za-z]', '', 'g')), 'T', 'U')"
_DRAW = "CAST(('0x' || substr(md5(concat_ws('|', 5, '@', aln_id, k)), 1, 8)) AS BIGINT)"

ORACLE = {
    # even emissions: the probability of a length, over the numbers of pairs, is a sum of Motzkin path counts
    "inside_g5": f"WITH {_R}{_LEN}, u AS (SELECT DISTINCT n FROM w), s AS (SELECT n, p, lgamma(n + 1) - lgamma(n - 2 * p + 1) - lgamma(p + 1) - lgamma(p + 2) + (n - 2 * p) * ln(0.4) + p * ln(0.2) + (p + 1) * ln(0.4) - n * ln(4) AS t FROM (SELECT n, unnest(range(0, n // 2 + 1)) AS p FROM u)), m AS (SELECT n, max(t) AS m FROM s GROUP BY 1), g AS (SELECT s.n, max(m) + ln(sum(exp(t - m))) AS logp FROM s JOIN m ON m.n = s.n GROUP BY 1) SELECT seq_id, {O.r('g.logp', 'logp', 5)} FROM w JOIN g ON g.n = w.n",
    "gt_shifted": f"WITH {O.CELLS['embeddings']}, {O.PROBS}, {O.stat('gt', 't16', 's16')}, {O.means('s16')}, c AS (SELECT aln_id, i, j, CASE WHEN g <> 0 THEN v - ri * rj / g ELSE 0 END AS apc, v - (ri + rj - g) AS a FROM corr) SELECT aln_id, i, j, {O.r('apc - min(apc) OVER (PARTITION BY aln_id)', 'apc')}, {O.r('a - min(a) OVER (PARTITION BY aln_id)', '\"asc\"')} FROM c",
    "raf_corrected": _RAF + f" SELECT aln_id, i, j, {O.r('CASE WHEN g <> 0 THEN v - ri * rj / g ELSE 0 END', 'apc')}, {O.r('v - (ri + rj - g)', '\"asc\"')} FROM corr",
    "ccf_corrected": f"""WITH {O.CELLS["embeddings"]}, {O.PROBS}, mv AS (SELECT aln_id, x, s / sum(s) OVER (PARTITION BY aln_id) AS mx FROM (SELECT aln_id, x, sum(m) AS s FROM pm GROUP BY 1, 2)),
t AS (SELECT pp.aln_id, pp.i, pp.j, nseff, (nseff * a.m - u.mx) * (nseff * b.m - v.mx) AS d FROM pp JOIN pm a ON a.aln_id = pp.aln_id AND a.col = pp.i AND a.x = pp.x JOIN pm b ON b.aln_id = pp.aln_id AND b.col = pp.j AND b.x = pp.y
 JOIN mv u ON u.aln_id = pp.aln_id AND u.x = pp.x JOIN mv v ON v.aln_id = pp.aln_id AND v.x = pp.y),
s16 AS (SELECT aln_id, i, j, max(nseff) AS nseff, sqrt(sum(d * d)) AS v FROM t GROUP BY 1, 2, 3), {O.means("s16")} SELECT aln_id, i, j, {O.r('CASE WHEN g <> 0 THEN v - ri * rj / g ELSE 0 END', 'apc', 4)} FROM corr""",
    "joint_gap_probs": f"""WITH {O.CELLS["events"]}, {O.GRID}, sq AS (SELECT DISTINCT aln_id, seq FROM cells),
lv AS (SELECT cols.aln_id, sq.seq, cols.col, CASE WHEN c.res < 4 THEN c.res ELSE 4 END AS x FROM cols JOIN sq ON sq.aln_id = cols.aln_id LEFT JOIN cells c ON c.aln_id = cols.aln_id AND c.seq = sq.seq AND c.col = cols.col),
k AS (SELECT a.aln_id, a.col AS i, b.col AS j, a.x * 5 + b.x AS xy, count(*) AS c FROM lv a JOIN lv b ON a.aln_id = b.aln_id AND a.seq = b.seq AND a.col < b.col GROUP BY ALL)
SELECT prs.aln_id, prs.i, prs.j, {", ".join(O.r(f"(coalesce(max(CASE WHEN xy = {c} THEN c END), 0) + 1e-10) / (max(n) + 25e-10)", f"p{c}", 9) for c in range(25))} FROM prs JOIN k ON k.aln_id = prs.aln_id AND k.i = prs.i AND k.j = prs.j GROUP BY 1, 2, 3""",
    "pair_composition": f"""WITH {O.CELLS["events"]}, {O.PROBS}, s AS (SELECT aln_id, i, j, max(n) AS n, max(nseff) AS e, sum(CASE WHEN x + y = 3 THEN c ELSE 0 END) AS w, sum(CASE WHEN x + y = 5 THEN c ELSE 0 END) AS b FROM pp GROUP BY 1, 2, 3)
SELECT aln_id, i, j, {O.r('CASE WHEN e > 0 THEN w / e ELSE 0 END', 'wcf')}, {O.r('CASE WHEN e > 0 THEN b / e ELSE 0 END', 'wobble')}, {O.r('CASE WHEN e > 0 THEN 1 - w / e - b / e ELSE 1 END', 'noncan')}, {O.r('100 * e / n', 'nseff_pct')} FROM s""",
    "recoded_gaps": f"WITH {_ROWS} SELECT seq_id, replace(regexp_replace(replace(upper(aseq), 'T', 'U'), '[B-FH-TV-Z]', '-', 'g'), '~', '-') AS aseq FROM rows WHERE aseq IS NOT NULL",
    "paired_composition": _CT.replace("WITH ", f"WITH {_LONG}, ", 1) + """, pc AS (SELECT DISTINCT aln_id, unnest([i, j]) AS col FROM ct)
SELECT l.aln_id, pc.col IS NOT NULL AS paired, """ + ", ".join(f"count(*) FILTER (WHERE sym = '{x}') AS n_{x.lower()}" for x in "ACGU") + " FROM long l LEFT JOIN pc ON pc.aln_id = l.aln_id AND pc.col = l.col GROUP BY 1, 2",
    "same_composition": f"""WITH {_ROWS}, t AS (SELECT aln_id, seq_id, {_RES} AS a, coalesce(length(regexp_replace(aseq, '[^A-Za-z]', '', 'g')), 0) AS len FROM rows), k AS (SELECT *, len > CAST(0.7 AS DOUBLE) * avg(len) OVER (PARTITION BY aln_id) AS kept FROM t)
SELECT aln_id, CASE WHEN count(*) FILTER (WHERE kept) = 0 THEN NULL ELSE coalesce(sum(length(a)), 0) = coalesce(sum(CASE WHEN kept THEN length(a) END), 0) END AS same FROM k GROUP BY 1""",
    "single_rows": f"WITH {_ROWS}, n AS (SELECT *, count(*) OVER (PARTITION BY aln_id) AS n FROM rows) SELECT seq_id, CASE WHEN n = 1 THEN regexp_replace(aseq, '[-._~]', '', 'g') ELSE aseq END AS aseq FROM n WHERE aseq IS NOT NULL",
    "ordered_rows": f"WITH {_ROWS} SELECT aln_id, seq_id, CAST(row_number() OVER (PARTITION BY aln_id ORDER BY coalesce(length(aseq), 0) DESC, seq_id) - 1 AS INTEGER) AS seq_idx FROM rows",
    "window_columns": f"""WITH k AS ({ALN["gap_columns"]}), w AS ({ALN["sliding_windows"]}) SELECT k.aln_id, w."window", k.col FROM k JOIN w ON w.aln_id = k.aln_id AND k.col BETWEEN w."first" AND w."last" """,
    "homology_counts": f"WITH {_ROWS}, t AS (SELECT aln_id, sum(length(regexp_replace(aseq, '[^A-Z]', '', 'g'))) AS u, sum(length(regexp_replace(aseq, '[^A-Za-z]', '', 'g'))) AS n FROM rows WHERE regexp_matches(aseq, '[A-Za-z]') GROUP BY 1) SELECT aln_id, CAST(u AS BIGINT) AS n_ref, CAST(n AS BIGINT) AS n_inf, CAST(u AS BIGINT) AS n_both FROM t",
    "cluster_weights": _CL.replace("@", "0.62") + f", z AS (SELECT aln_id, seq, count(*) OVER (PARTITION BY aln_id, cluster) AS n, count(*) OVER (PARTITION BY aln_id) AS a FROM cl), k AS (SELECT aln_id, count(DISTINCT cluster) AS k FROM cl GROUP BY 1) SELECT z.aln_id, seq, {O.r('a / (k * n)', 'w')} FROM z JOIN k ON k.aln_id = z.aln_id",
    "largest_clusters": _CL.replace("@", "0.5") + ", z AS (SELECT aln_id, cluster, count(*) AS n FROM cl GROUP BY 1, 2), b AS (SELECT aln_id, arg_max(cluster, (n, -cluster)) AS cluster FROM z GROUP BY 1) SELECT cl.aln_id, seq FROM cl JOIN b ON b.aln_id = cl.aln_id AND b.cluster = cl.cluster",
    "repaired_pairs": _CT + f""", k AS ({ALN["gap_columns"]}) SELECT ct.aln_id, ct.layer, a.i, b.i AS j FROM ct JOIN k a ON a.aln_id = ct.aln_id AND a.col = ct.i JOIN k b ON b.aln_id = ct.aln_id AND b.col = ct.j""",
    "excluded_pairs": _CT + ", n AS (SELECT DISTINCT aln_id, layer FROM ct) SELECT ct.aln_id, n.layer, i, j FROM ct JOIN n ON n.aln_id = ct.aln_id AND n.layer <> ct.layer",
    "motif_places": f"WITH {_ROWS}, t AS (SELECT seq_id, {_RES} AS a FROM rows WHERE aseq IS NOT NULL), m(motif, pat, n) AS (VALUES ('tetra', 'G[ACGU][AG]A', 4), ('bulge', 'CU[CU]G', 4), ('turn', 'UGA[ACGU]', 4)), p AS (SELECT seq_id, motif, pat, n, a, unnest(range(1, length(a) - 2)) AS pos FROM t, m) SELECT seq_id, motif, CAST(pos AS INTEGER) AS pos FROM p WHERE regexp_matches(substr(a, pos, n), '^' || pat || '$')",
    "power_types": _BR + ", q AS (SELECT a.aln_id, a.col AS i, b.col AS j, count(*) FILTER (WHERE a.ch AND b.ch) AS d, count(*) FILTER (WHERE a.ch OR b.ch) AS e FROM br a JOIN br b ON a.aln_id = b.aln_id AND a.k = b.k AND a.col < b.col GROUP BY 1, 2, 3) SELECT aln_id, i, j, CASE WHEN d > 0 THEN 'double' WHEN e > 2 THEN 'join' ELSE 'single' END AS kind FROM q",
    "prepared_pairs": _E + f" SELECT aln_id, i, j, score, {O.r('least(evalue, 10)', 'evalue')} FROM ev",
    "power_curve": _E + f" SELECT CAST((j - i) // 4 * 4 AS BIGINT) AS subs, count(*) AS n, count(*) FILTER (WHERE evalue < 0.05) AS covarying, {O.r('count(*) FILTER (WHERE evalue < 0.05) / count(*)', 'prob')} FROM ev GROUP BY 1",
    "family_segments": _E + f""", g AS (SELECT aln_id AS family, count(*) FILTER (WHERE evalue < 5) AS found, count(*) FILTER (WHERE is_bp) AS "true", count(*) FILTER (WHERE is_bp AND evalue < 5) AS tp FROM ev GROUP BY 1), q AS (SELECT *, {_SP} FROM g)
SELECT family, CASE WHEN found % 3 <= 0 THEN 'no power' WHEN sen > 0 THEN 'covaries' WHEN "true" / 16 <= 2 THEN 'grey zone' ELSE 'power without covariation' END AS segment FROM q""",
    "random_baseline": f"""WITH {_ROWS}, w AS (SELECT aln_id, max(length(aseq)) AS n FROM rows GROUP BY 1 HAVING max(length(aseq)) >= 2), d AS (SELECT aln_id, n, k, {_DRAW.replace('@', 'a')} % n + 1 AS a, {_DRAW.replace('@', 'b')} % (n - 1) + 1 AS s FROM w, range(1, 21) t(k)), e AS (SELECT *, (a - 1 + s) % n + 1 AS b FROM d)
SELECT aln_id, CAST(k AS INTEGER) AS k, CAST(least(a, b) AS INTEGER) AS i, CAST(greatest(a, b) AS INTEGER) AS j FROM e""",
    "score_split": _E + f" SELECT CASE WHEN is_bp THEN 'pair' ELSE 'other' END AS kind, count(*) AS n, {O.r('avg(score)', 'mean', 4)}, {O.r('stddev_pop(score)', 'sd', 4)}, {O.r('max(score)', 'top', 4)} FROM ev GROUP BY 1",
    "score_median": "WITH h AS (SELECT hit_id, min(CASE WHEN isnan(sc) THEN NULL ELSE sc END) AS sc FROM domain_hits WHERE hit_id IS NOT NULL GROUP BY 1), b AS (SELECT CAST(least(greatest(floor(sc / 100 * 10), 0), 29) AS INTEGER) AS bin, count(*) AS n FROM h WHERE sc IS NOT NULL GROUP BY 1), c AS (SELECT bin, sum(n) OVER (ORDER BY bin) / sum(n) OVER () AS upto FROM b) SELECT CAST((max(bin) + 0.5) / 10 AS DOUBLE) AS median FROM c WHERE upto <= 0.5",
    "structure_summary": _HLX + f""", h AS (SELECT aln_id, count(*) AS n_helices, avg(n) AS m, coalesce(stddev_samp(n), 0) AS sd FROM he GROUP BY 1), p AS (SELECT aln_id, count(*) // 2 AS n_pairs, count(DISTINCT c) AS n_columns FROM (SELECT aln_id, unnest([i, j]) AS c FROM ct) GROUP BY 1)
SELECT p.aln_id, CAST(n_pairs AS BIGINT) AS n_pairs, n_columns, n_helices, {O.r('m', 'mean_pairs')}, {O.r('sd', 'sd_pairs')} FROM p JOIN h ON h.aln_id = p.aln_id""",
    "contacts_between": f"""WITH t AS (SELECT label AS c, CAST(vec_id // 10 AS INTEGER) AS r, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings),
d AS (SELECT a.c AS chain_a, a.r AS i, b.c AS chain_b, b.r AS j, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS d FROM t a JOIN t b ON a.c < b.c) SELECT chain_a, i, chain_b, j, {O.r('min(d)', 'dist', 7)} FROM d WHERE d < 0.04 GROUP BY 1, 2, 3, 4""",
    "hits_again": _E + f" SELECT aln_id AS family, CASE WHEN is_bp THEN '*' ELSE '' END AS mark, i AS left_pos, j AS right_pos, {O.r("score", "score")}, {O.r("evalue", "evalue", 4)} FROM ev WHERE evalue < 5",
    "whole_motif": _HLX.replace("WITH ", f"WITH {_R}", 1) + ", lp AS (SELECT r.aln_id, layer, helix, replace(upper(substr(aseq, i_in + 1, 4)), 'T', 'U') AS s FROM rows r JOIN he ON he.aln_id = r.aln_id WHERE j_in - i_in = 5) SELECT aln_id, layer, CAST(helix AS INTEGER) AS helix, count(*) AS n_rows FROM lp WHERE regexp_matches(s, '^G[ACGU][AG]A$') GROUP BY 1, 2, 3",
}
for _name, _l1, _tail, _sn, _lx, _s1, _f1 in (("inside_g6", "0.7", "", "0.6 * nsplit + 0.4 * (nl)", "", "0.4 * 0.7", "0"), ("inside_g6x", "0.7", " + nl * 0.4", "0.6 * nsplit", " + CASE WHEN n = 1 THEN 0.1 ELSE 0 END", "0.6 * 0.7 * 0.4", "0.4 * 0.7 * 0.4")):
    # the probability that the grammar makes a length, by convolution; in G6X, S may end at once, so the last split leaves nothing
    _fn = "0.4 * nsplit + CASE WHEN n >= 2 THEN 0.6 * fx[n - 1] ELSE 0 END" if _name == "inside_g6" else "0.4 * nsplit + CASE WHEN n >= 2 THEN 0.5 * fx[n - 1] ELSE 0.1 END"
    ORACLE[_name] = f"WITH RECURSIVE {_R}{_LEN}, mx AS (SELECT max(n) AS mx FROM w), " + _G6.format(l1=f"{_l1}::DOUBLE", s1=f"({_s1})::DOUBLE", f1=f"({_f1})::DOUBLE", ln="nl", sn=_sn, fn=_fn, lp="0.3" if _name == "inside_g6" else "0.2", lx=_lx, tail=_tail).replace("n < 4000", "n < (SELECT mx FROM mx)") + f", g AS (SELECT unnest(range(1, n + 1)) AS n, unnest(sx) AS p FROM (SELECT * FROM l ORDER BY n DESC LIMIT 1)) SELECT seq_id, {O.r('CASE WHEN p > 0 THEN ln(p) - w.n * ln(4) END', 'logp', 5)} FROM w JOIN g ON g.n = w.n"
