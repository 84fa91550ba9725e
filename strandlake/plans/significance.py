"""Queries from scores to hits: null histograms, tails, E-values, ROC, power and combined p-values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators import filters as X
from strandlake.operators import pairs as P
from strandlake.operators import power as PW
from strandlake.operators import pseudo
from strandlake.operators import significance as S
from strandlake.operators import structure as T
from strandlake.plans import oracle as O
from strandlake.plans.covariation import rnd
from strandlake.storage import materialize
from strandlake.tables import once, table

CURVE = [(0.0, 0.0), (5.0, 0.1), (10.0, 0.5), (20.0, 0.9)]


def scored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Corrected G-test scores of the vectors' alignments, and of their columns shuffled: replicates are alignments of their own, so one job does both."""
    c = pseudo.embeddings_cells(spark, sf_dir)
    null = X.shuffle_within_columns(c, 11).withColumn("aln_id", F.concat("aln_id", F.lit("#n"))).drop("rep")
    both = materialize(c.unionByName(null), "cells")
    pp = P.with_marginals(materialize(P.joint(P.joint_counts(both)), "joint"))
    d = P.correct(materialize(pp.select("aln_id", "i", "j", P.covariation("gt").alias("gt")), "gt"), "gt")
    d = materialize(d.select("aln_id", "i", "j", rnd(F.col("gt_apc")).alias("score")), "scores")
    isnull = F.col("aln_id").endswith("#n")
    return d.where(~isnull), d.where(isnull).withColumn("aln_id", F.expr("substring(aln_id, 1, length(aln_id) - 2)"))


def hairpin(scores: DataFrame) -> DataFrame:
    """(aln_id, i, j): the first column pairs with the last, and so on inwards."""
    n = scores.groupBy("aln_id").agg(F.max("j").alias("n"))
    return scores.join(n, "aln_id").where(F.col("i") + F.col("j") == F.col("n") + 1).select("aln_id", "i", "j")


def _null(spark, sf_dir):
    real, null = scored(spark, sf_dir)
    frame = S.bin_frame(null)
    hist = materialize(S.histogram(null, frame), "hist")
    fit = S.fit_exponential(hist, S.tail(hist), frame)
    return real, frame, hist, fit


def _evalues(spark, sf_dir):
    real, frame, hist, fit = _null(spark, sf_dir)
    return S.e_values(S.p_values(real, hist, fit, frame), hairpin(real))


def null_histogram(spark, sf_dir) -> DataFrame:
    return _null(spark, sf_dir)[2]


def tail_fit(spark, sf_dir) -> DataFrame:
    f = _null(spark, sf_dir)[3]
    return f.select("aln_id", *(rnd(F.col(c)).alias(c) for c in ("phi", "mass", "lam")), "nc")


def null_survival(spark, sf_dir) -> DataFrame:
    _, frame, hist, fit = _null(spark, sf_dir)
    s = S.survival(hist, fit, frame)
    return s.select("aln_id", "bin", rnd(F.col("hi")).alias("hi"), "above", "nc", rnd(F.col("surv")).alias("surv"), rnd(F.col("survfit")).alias("survfit"))


def e_values(spark, sf_dir) -> DataFrame:
    return _evalues(spark, sf_dir).select("aln_id", "i", "j", "score", rnd(F.col("pval"), 8).alias("pval"), "is_bp", rnd(F.col("evalue")).alias("evalue"))


def hits(spark, sf_dir) -> DataFrame:
    """Pairs with E below 5, with their mark."""
    h = S.hits(_evalues(spark, sf_dir), 5.0)
    return h.select("aln_id", F.when(F.col("is_bp"), "*").otherwise("").alias("mark"), F.col("i").alias("left_pos"), F.col("j").alias("right_pos"), "score", rnd(F.col("evalue"), 5).alias("evalue"))


def e_values_one_set(spark, sf_dir) -> DataFrame:
    """All pairs as one set of tests."""
    real, frame, hist, fit = _null(spark, sf_dir)
    e = S.e_values(S.p_values(real, hist, fit, frame), hairpin(real), two_sets=False)
    return e.select("aln_id", "i", "j", "is_bp", rnd(F.col("evalue")).alias("evalue"))


def e_values_expected(spark, sf_dir) -> DataFrame:
    """The first 20 hits outside the base pairs count against 20 tests."""
    real, frame, hist, fit = _null(spark, sf_dir)
    e = S.e_values(S.p_values(real, hist, fit, frame), hairpin(real), 20)
    return e.select("aln_id", "i", "j", rnd(F.col("evalue")).alias("evalue"))


def score_thresholds(spark, sf_dir) -> DataFrame:
    """The score at which 2016 tests have an E-value of 5."""
    _, frame, hist, fit = _null(spark, sf_dir)
    return S.score_at(hist, fit, frame, 2016, 5.0).select("aln_id", rnd(F.col("score")).alias("score"))


def gamma_tail(spark, sf_dir) -> DataFrame:
    _, frame, hist, _ = _null(spark, sf_dir)
    g = S.fit_gamma(hist, S.tail(hist), frame)
    return g.select("aln_id", *(rnd(F.col(c)).alias(c) for c in ("phi", "mass", "lam", "tau")), "nc")


def merged_nulls(spark, sf_dir) -> DataFrame:
    """Two replicates' histograms as one, in the bins of both together."""
    null = scored(spark, sf_dir)[1]
    frame = S.bin_frame(null)
    odd, even = null.where("i % 2 = 1"), null.where("i % 2 = 0")
    return S.merge(S.histogram(odd, frame), S.histogram(even, frame))


def marked_pairs(spark, sf_dir) -> DataFrame:
    """Marks of the pairs with E below 5: first and last columns pair, every seventh diagonal is a stack, every eleventh a contact."""
    ev = S.hits(_evalues(spark, sf_dir), 5.0)
    d = F.col("j") - F.col("i")
    kind = F.when(F.col("is_bp") & (F.col("i") % 2 == 0), S.WWC).when(F.col("is_bp"), 5).when(d % 7 == 0, S.STACKED).when(d % 11 == 0, 13).otherwise(S.NONE)
    ct = ev.where("is_bp").select("aln_id", "i", "j")
    free = T.compatible(ev.select("aln_id", "i", "j"), ct).withColumn("free", F.lit(True))
    m = ev.join(free, ["aln_id", "i", "j"], "left").withColumn("free", F.coalesce("free", F.lit(False)))
    return m.select("aln_id", "i", "j", S.pair_mark(kind, F.col("free")).alias("mark"))


def null_counts(spark, sf_dir) -> DataFrame:
    a = once(table(spark, sf_dir, "alignments"), "aln_id", "nseq", "alen").where("nseq > 0 AND alen > 0")
    return a.select("aln_id", S.null_count(F.col("nseq"), F.col("alen")).cast("int").alias("n_nulls"))


def hit_summary(spark, sf_dir) -> DataFrame:
    s = S.summary(_evalues(spark, sf_dir), 5.0)
    return s.select("aln_id", "found", "true", "tp", *(rnd(F.col(c)).alias(c) for c in ("sen", "ppv", "f")))


def roc(spark, sf_dir) -> DataFrame:
    r = S.roc(_evalues(spark, sf_dir))
    return r.select("aln_id", "score", "found", "tp", "fp", "true", "neg", *(rnd(F.col(c)).alias(c) for c in ("sen", "ppv", "f")))


def survival_curves(spark, sf_dir) -> DataFrame:
    s = S.survival_curves(_evalues(spark, sf_dir))
    return s.select("aln_id", "curve", "score", rnd(F.col("p")).alias("p"))


def z_scores(spark, sf_dir) -> DataFrame:
    real, _ = scored(spark, sf_dir)
    return S.z_scores(real, hairpin(real)).select("aln_id", "i", "j", rnd(F.col("z"), 5).alias("z"))


def _motifs(spark, sf_dir):
    return _evalues(spark, sf_dir).select("aln_id", (F.col("i") + F.col("j")).alias("motif"), F.greatest(F.col("pval"), F.lit(1e-12)).alias("pval"))


def fisher_groups(spark, sf_dir) -> DataFrame:
    """P-values combined along every diagonal i + j."""
    c = PW.combine(_motifs(spark, sf_dir), "fisher")
    return c.select("aln_id", F.col("motif").cast("int").alias("motif"), "n", rnd(F.col("pval"), 5).alias("pval"))


def sidak_groups(spark, sf_dir) -> DataFrame:
    c = PW.combine(_motifs(spark, sf_dir), "sidak")
    return c.select("aln_id", F.col("motif").cast("int").alias("motif"), "n", rnd(F.col("pval"), 7).alias("pval"))


def _branches(spark, sf_dir):
    c = pseudo.events_cells(spark, sf_dir)
    return PW.branches(c, PW.rank_tree(c))


def column_subs(spark, sf_dir) -> DataFrame:
    return PW.column_subs(_branches(spark, sf_dir))


def pair_subs(spark, sf_dir) -> DataFrame:
    return PW.pair_subs(_branches(spark, sf_dir))


def _powers(spark, sf_dir):
    c = PW.column_subs(_branches(spark, sf_dir))
    a, b = c.select("aln_id", F.col("col").alias("i"), F.col("nsubs").alias("si")), c.select("aln_id", F.col("col").alias("j"), F.col("nsubs").alias("sj"))
    d = a.join(b, "aln_id").where("i < j").withColumn("nsubs", F.col("si") + F.col("sj"))
    return d.select("aln_id", "i", "j", "nsubs", PW.lookup(d, "nsubs", CURVE).alias("power"))


def pair_power(spark, sf_dir) -> DataFrame:
    return _powers(spark, sf_dir)


def power_summary(spark, sf_dir) -> DataFrame:
    """Expected and observed covarying pairs among the vectors' base pairs."""
    c = pseudo.embeddings_cells(spark, sf_dir)
    n = PW.column_subs(PW.branches(c, PW.rank_tree(c)))
    ev = _evalues(spark, sf_dir).where("is_bp").join(n.select("aln_id", F.col("col").alias("i"), F.col("nsubs").alias("si")), ["aln_id", "i"]).join(n.select("aln_id", F.col("col").alias("j"), F.col("nsubs").alias("sj")), ["aln_id", "j"])
    d = ev.withColumn("nsubs", F.col("si") + F.col("sj"))
    s = PW.power_summary(d.withColumn("power", PW.lookup(d, "nsubs", CURVE)))
    return s.select("aln_id", "n_bp", *(rnd(F.col(c)).alias(c) for c in ("expected", "sd", "mean_subs")), "observed")


QUERIES = {f.__name__: f for f in (e_values_one_set, e_values_expected, score_thresholds, gamma_tail, merged_nulls, marked_pairs, null_counts, null_histogram, tail_fit, null_survival, e_values, hits, hit_summary, roc, survival_curves, z_scores, fisher_groups, sidak_groups, column_subs, pair_subs, pair_power, power_summary)}

_SC = f"""WITH {O.CELLS["embeddings"].replace("cells AS", "base AS", 1)},
pc AS (SELECT *, row_number() OVER (PARTITION BY aln_id, col ORDER BY seq) AS o, row_number() OVER (PARTITION BY aln_id, col ORDER BY md5(concat_ws('|', 11, 1, aln_id, col, seq)), seq) AS n FROM base WHERE res < 4),
cells AS (SELECT aln_id, seq, col, res FROM base UNION ALL SELECT a.aln_id || '#n', a.seq, a.col, b.res FROM pc a JOIN pc b ON a.aln_id = b.aln_id AND a.col = b.col AND a.o = b.n),
{O.PROBS}, {O.stat("gt", "t16", "s16")}, {O.means("s16")},
sc AS (SELECT aln_id, i, j, {O.r("CASE WHEN g <> 0 THEN v - ri * rj / g ELSE 0 END", "score")} FROM corr),
re AS (SELECT * FROM sc WHERE NOT suffix(aln_id, '#n')), nu AS (SELECT replace(aln_id, '#n', '') AS aln_id, i, j, score FROM sc WHERE suffix(aln_id, '#n')),
hp AS (SELECT re.aln_id, i, j FROM re JOIN (SELECT aln_id, max(j) AS l FROM re GROUP BY 1) m ON m.aln_id = re.aln_id WHERE i + j = l + 1)"""
_H = _SC + """,
fr AS (SELECT aln_id, min(score) AS bmin, greatest((max(score) - min(score)) / 100, 1e-6) AS w FROM nu GROUP BY 1),
h AS (SELECT nu.aln_id, CAST(greatest(0, ceil((score - bmin) / w) - 1) AS INTEGER) AS bin, count(*) AS obs FROM nu JOIN fr ON fr.aln_id = nu.aln_id GROUP BY ALL),
cu AS (SELECT *, sum(obs) OVER (PARTITION BY aln_id ORDER BY bin DESC) AS above, sum(obs) OVER (PARTITION BY aln_id) AS nc, row_number() OVER (PARTITION BY aln_id ORDER BY bin DESC) / count(*) OVER (PARTITION BY aln_id) AS frac FROM h),
tl AS (SELECT aln_id, max(bin) AS phi_bin, arg_max(above / nc, bin) AS mass, max(nc) AS nc FROM cu WHERE above / nc >= CAST(0.05 AS DOUBLE) OR frac >= 1 GROUP BY 1),
kk AS (SELECT h.aln_id, sum(obs * (bin - phi_bin)) / sum(obs) AS k FROM h JOIN tl ON tl.aln_id = h.aln_id WHERE bin >= phi_bin GROUP BY 1),
ft AS (SELECT tl.aln_id, bmin + phi_bin * w AS phi, mass, CASE WHEN k > 0 THEN ln(1 + 1 / k) / w END AS lam, nc FROM tl JOIN kk ON kk.aln_id = tl.aln_id JOIN fr ON fr.aln_id = tl.aln_id)"""
_E = _H + """,
rb AS (SELECT re.*, CAST(greatest(0, ceil((score - bmin) / w) - 1) AS INTEGER) AS bin FROM re JOIN fr ON fr.aln_id = re.aln_id),
ab AS (SELECT rb.aln_id, rb.i, rb.j, rb.score, rb.bin, coalesce(sum(obs), 0) AS a FROM rb LEFT JOIN h ON h.aln_id = rb.aln_id AND h.bin >= rb.bin GROUP BY ALL),
tb AS (SELECT aln_id, min(bin) AS imin, max(bin) AS imax, greatest(100, max(bin) + 1) AS nb FROM h GROUP BY 1),
pv AS (SELECT ab.aln_id, ab.i, ab.j, score, CASE WHEN lam IS NOT NULL AND (score >= phi OR ab.bin >= 2 * nb - 1) THEN mass * exp(-lam * (bmin + least(ab.bin + 2, 2 * nb) * w - phi)) WHEN ab.bin >= imax - 1 THEN 1 / nc ELSE greatest(a, 1) / nc END AS pval
 FROM ab JOIN ft ON ft.aln_id = ab.aln_id JOIN tb ON tb.aln_id = ab.aln_id JOIN fr ON fr.aln_id = ab.aln_id),
ev AS (SELECT *, CASE WHEN is_bp THEN pval * sum(CAST(is_bp AS INTEGER)) OVER (PARTITION BY aln_id) ELSE pval * sum(1 - CAST(is_bp AS INTEGER)) OVER (PARTITION BY aln_id) END AS evalue
 FROM (SELECT pv.*, hp.i IS NOT NULL AS is_bp FROM pv LEFT JOIN hp ON hp.aln_id = pv.aln_id AND hp.i = pv.i AND hp.j = pv.j))"""
_RATES = f"{O.r('sen', 'sen')}, {O.r('ppv', 'ppv')}, {O.r('CASE WHEN sen + ppv > 0 THEN 2 * sen * ppv / (sen + ppv) ELSE 0 END', 'f')}"
_SP = 'CASE WHEN "true" > 0 THEN 100.0 * tp / "true" ELSE 0 END::DOUBLE AS sen, CASE WHEN found > 0 THEN 100.0 * tp / found ELSE 0 END::DOUBLE AS ppv'
_G = ", g AS (SELECT aln_id, i + j AS motif, count(*) AS n, sum(ln(greatest(pval, 1e-12))) AS s, min(greatest(pval, 1e-12)) AS m FROM ev GROUP BY 1, 2)"
_BR = f"""WITH {O.CELLS["events"]}, tr AS (SELECT aln_id, seq, row_number() OVER (PARTITION BY aln_id ORDER BY seq) AS k FROM (SELECT DISTINCT aln_id, seq FROM cells)),
cc AS (SELECT c.aln_id, k, col, res FROM cells c JOIN tr ON tr.aln_id = c.aln_id AND tr.seq = c.seq WHERE res < 4),
br AS (SELECT a.aln_id, a.k, a.col, b.res <> a.res AS ch FROM cc a JOIN cc b ON a.aln_id = b.aln_id AND a.col = b.col AND b.k = a.k // 2 WHERE a.k >= 2),
cs AS (SELECT aln_id, col, CAST(sum(CAST(ch AS INTEGER)) AS BIGINT) AS nsubs FROM br GROUP BY 1, 2),
pw AS (SELECT a.aln_id, a.col AS i, b.col AS j, a.nsubs + b.nsubs AS nsubs FROM cs a JOIN cs b ON a.aln_id = b.aln_id AND a.col < b.col),
po AS (SELECT *, CAST(CASE WHEN nsubs > 20 THEN 0.9 WHEN nsubs > 10 THEN 0.5 WHEN nsubs > 5 THEN 0.1 ELSE 0 END AS DOUBLE) AS power FROM pw)"""

ORACLE = {
    "e_values_one_set": _E + f" SELECT aln_id, i, j, is_bp, {O.r('pval * count(*) OVER (PARTITION BY aln_id)', 'evalue')} FROM ev",
    "e_values_expected": _E + f", ex AS (SELECT *, coalesce(sum(CASE WHEN NOT is_bp AND pval * 20 < 0.05 THEN 1 ELSE 0 END) OVER (PARTITION BY aln_id ORDER BY i, j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ev) SELECT aln_id, i, j, {O.r('CASE WHEN NOT is_bp AND before < 20 THEN pval * 20 ELSE evalue END', 'evalue')} FROM ex",
    "score_thresholds": _H + f""", tb AS (SELECT aln_id, min(bin) AS imin, greatest(100, max(bin) + 1) AS nb FROM h GROUP BY 1),
fb AS (SELECT ft.aln_id, max(b) AS b FROM ft JOIN tb ON tb.aln_id = ft.aln_id JOIN tl ON tl.aln_id = ft.aln_id JOIN fr ON fr.aln_id = ft.aln_id, range(0, 2000) r(b) WHERE b >= phi_bin AND b < 2 * nb AND ft.nc >= 10 AND ft.mass * exp(-lam * (bmin + (b + 1) * w - phi)) * 2016 >= 5 GROUP BY 1),
sb AS (SELECT aln_id, max(bin) AS b FROM cu WHERE above * 2016 >= 5 * nc GROUP BY 1)
SELECT fr.aln_id, {O.r('CASE WHEN fb.b IS NOT NULL THEN bmin + fb.b * w ELSE bmin + (coalesce(sb.b, imin - 1) + 1) * w END', 'score')} FROM fr JOIN tb ON tb.aln_id = fr.aln_id LEFT JOIN fb ON fb.aln_id = fr.aln_id LEFT JOIN sb ON sb.aln_id = fr.aln_id""",
    "gamma_tail": _H + f", m AS (SELECT h.aln_id, sum(obs * (bin - phi_bin + 0.5::DOUBLE) * w) / sum(obs) AS m, sum(obs * ((bin - phi_bin + 0.5::DOUBLE) * w) ** 2) / sum(obs) AS q FROM h JOIN tl ON tl.aln_id = h.aln_id JOIN fr ON fr.aln_id = h.aln_id WHERE bin >= phi_bin GROUP BY 1) SELECT ft.aln_id, {O.r('phi', 'phi')}, {O.r('mass', 'mass')}, {O.r('CASE WHEN q - m * m > 1e-12 THEN m / (q - m * m) END', 'lam')}, {O.r('CASE WHEN q - m * m > 1e-12 THEN m * m / (q - m * m) END', 'tau')}, CAST(nc AS BIGINT) AS nc FROM ft JOIN m ON m.aln_id = ft.aln_id",
    "merged_nulls": _H + " SELECT aln_id, bin, obs FROM h",
    "marked_pairs": _E + """, hi AS (SELECT * FROM ev WHERE evalue < 5), u AS (SELECT DISTINCT aln_id, unnest([i, j]) AS c FROM hi WHERE is_bp),
k AS (SELECT hi.*, NOT EXISTS (SELECT 1 FROM u WHERE u.aln_id = hi.aln_id AND (u.c = hi.i OR u.c = hi.j)) AS free FROM hi)
SELECT aln_id, i, j, CASE WHEN is_bp AND i % 2 = 0 THEN '*' WHEN is_bp THEN '**' WHEN (j - i) % 7 = 0 OR (j - i) % 11 = 0 THEN CASE WHEN free THEN 'c~' ELSE 'c' END WHEN free THEN '~' ELSE ' ' END AS mark FROM k""",
    "null_counts": "WITH a AS (SELECT aln_id, min(nseq) AS nseq, min(alen) AS alen FROM alignments WHERE aln_id IS NOT NULL GROUP BY 1) SELECT aln_id, CASE WHEN CAST(nseq AS BIGINT) * alen < 1000 THEN 100 WHEN CAST(nseq AS BIGINT) * alen < 10000 THEN 50 ELSE 20 END AS n_nulls FROM a WHERE nseq > 0 AND alen > 0",
    "null_histogram": _H + " SELECT aln_id, bin, obs FROM h",
    "tail_fit": _H + f" SELECT aln_id, {O.r('phi', 'phi')}, {O.r('mass', 'mass')}, {O.r('lam', 'lam')}, CAST(nc AS BIGINT) AS nc FROM ft",
    "null_survival": _H + f" SELECT cu.aln_id, bin, {O.r('bmin + (bin + 1) * w', 'hi')}, CAST(above AS BIGINT) AS above, CAST(cu.nc AS BIGINT) AS nc, {O.r('above / cu.nc', 'surv')}, {O.r('CASE WHEN bmin + bin * w >= phi THEN mass * exp(-lam * (bmin + (bin + 1) * w - phi)) END', 'survfit')} FROM cu JOIN ft ON ft.aln_id = cu.aln_id JOIN fr ON fr.aln_id = cu.aln_id",
    "e_values": _E + f" SELECT aln_id, i, j, score, {O.r('pval', 'pval', 8)}, is_bp, {O.r('evalue', 'evalue')} FROM ev",
    "hits": _E + f" SELECT aln_id, CASE WHEN is_bp THEN '*' ELSE '' END AS mark, i AS left_pos, j AS right_pos, score, {O.r('evalue', 'evalue', 5)} FROM ev WHERE evalue < 5",
    "hit_summary": _E + f""", g AS (SELECT aln_id, count(*) FILTER (WHERE evalue < 5) AS found, count(*) FILTER (WHERE is_bp) AS "true", count(*) FILTER (WHERE is_bp AND evalue < 5) AS tp FROM ev GROUP BY 1), q AS (SELECT *, {_SP} FROM g) SELECT aln_id, found, "true", tp, {_RATES} FROM q""",
    "roc": _E + f""", g AS (SELECT aln_id, score, count(*) AS n, count(*) FILTER (WHERE is_bp) AS t FROM ev GROUP BY 1, 2), c AS (SELECT aln_id, score, CAST(sum(n) OVER w AS BIGINT) AS found, CAST(sum(t) OVER w AS BIGINT) AS tp, CAST(sum(t) OVER (PARTITION BY aln_id) AS BIGINT) AS "true", CAST(sum(n - t) OVER (PARTITION BY aln_id) AS BIGINT) AS neg FROM g WINDOW w AS (PARTITION BY aln_id ORDER BY score DESC)), q AS (SELECT *, {_SP} FROM c)
SELECT aln_id, score, found, tp, found - tp AS fp, "true", neg, {_RATES} FROM q""",
    "survival_curves": _E + f""", d AS (SELECT aln_id, 'all' AS curve, score FROM ev UNION ALL SELECT aln_id, CASE WHEN is_bp THEN 'bp' ELSE 'nonbp' END, score FROM ev), g AS (SELECT aln_id, curve, score, count(*) AS n FROM d GROUP BY ALL)
SELECT aln_id, curve, score, {O.r("sum(n) OVER (PARTITION BY aln_id, curve ORDER BY score DESC) / sum(n) OVER (PARTITION BY aln_id, curve)", "p")} FROM g""",
    "z_scores": _SC + f""", b AS (SELECT aln_id, i AS c, i, j, score FROM re UNION ALL SELECT aln_id, j, i, j, score FROM re),
z AS (SELECT hp.aln_id, hp.i, hp.j, re.score, (re.score - (SELECT avg(b.score) FROM b WHERE b.aln_id = hp.aln_id AND b.c = hp.i AND (b.i, b.j) <> (hp.i, hp.j))) / (SELECT stddev_samp(b.score) FROM b WHERE b.aln_id = hp.aln_id AND b.c = hp.i AND (b.i, b.j) <> (hp.i, hp.j)) AS zi,
 (re.score - (SELECT avg(b.score) FROM b WHERE b.aln_id = hp.aln_id AND b.c = hp.j AND (b.i, b.j) <> (hp.i, hp.j))) / (SELECT stddev_samp(b.score) FROM b WHERE b.aln_id = hp.aln_id AND b.c = hp.j AND (b.i, b.j) <> (hp.i, hp.j)) AS zj FROM hp JOIN re USING (aln_id, i, j))
SELECT aln_id, i, j, {O.r("least(zi, zj)", "z", 5)} FROM z""",
    "fisher_groups": _E + _G + f" SELECT aln_id, CAST(motif AS INTEGER) AS motif, n, {O.r('CASE WHEN n = 1 THEN m ELSE exp(s) * list_sum(list_transform(range(0, n), lambda k: exp(k * ln(greatest(-s, 1e-300)) - lgamma(k + 1)))) END', 'pval', 5)} FROM g",
    "sidak_groups": _E + _G + f" SELECT aln_id, CAST(motif AS INTEGER) AS motif, n, {O.r('CASE WHEN m >= 1 THEN 1 ELSE 1 - exp(n * ln(1 - m)) END', 'pval', 7)} FROM g",
    "column_subs": _BR + " SELECT aln_id, col, nsubs FROM cs",
    "pair_subs": _BR + ' SELECT a.aln_id, a.col AS i, b.col AS j, CAST(count(*) FILTER (WHERE a.ch AND b.ch) AS BIGINT) AS "double", CAST(count(*) FILTER (WHERE a.ch OR b.ch) AS BIGINT) AS "join" FROM br a JOIN br b ON a.aln_id = b.aln_id AND a.k = b.k AND a.col < b.col GROUP BY 1, 2, 3',
    "pair_power": _BR + " SELECT aln_id, i, j, nsubs, power FROM po",
    "power_summary": _E + f""", tr AS (SELECT aln_id, seq, row_number() OVER (PARTITION BY aln_id ORDER BY seq) AS k FROM (SELECT DISTINCT aln_id, seq FROM base)),
cc AS (SELECT c.aln_id, k, col, res FROM base c JOIN tr ON tr.aln_id = c.aln_id AND tr.seq = c.seq WHERE res < 4),
cs AS (SELECT a.aln_id, a.col, sum(CASE WHEN b.res <> a.res THEN 1 ELSE 0 END) AS n FROM cc a JOIN cc b ON a.aln_id = b.aln_id AND a.col = b.col AND b.k = a.k // 2 WHERE a.k >= 2 GROUP BY 1, 2),
po AS (SELECT ev.aln_id, evalue, x.n + y.n AS nsubs, CAST(CASE WHEN x.n + y.n > 20 THEN 0.9 WHEN x.n + y.n > 10 THEN 0.5 WHEN x.n + y.n > 5 THEN 0.1 ELSE 0 END AS DOUBLE) AS power FROM ev JOIN cs x ON x.aln_id = ev.aln_id AND x.col = ev.i JOIN cs y ON y.aln_id = ev.aln_id AND y.col = ev.j WHERE is_bp)
SELECT aln_id, count(*) AS n_bp, {O.r('sum(power)', 'expected')}, {O.r('sqrt(sum(power * (1 - power)))', 'sd')}, {O.r('avg(nsubs)', 'mean_subs')}, count(*) FILTER (WHERE evalue < 0.05) AS observed FROM po GROUP BY 1""",
}
