"""Null histograms, tail fits, E-values, hits, ROC and survival curves, for many alignments at once.

A score table is (aln_id, i, j, score). Histograms are mergeable counts; everything after them works on
tables of one row per bin, which windows by alignment sort cheaply.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def bin_of(score: Column, bmin: Column, w: Column) -> Column:
    """Bins are (lo, hi]: bin b holds bmin + b*w < score <= bmin + (b+1)*w; what lies at or below bmin goes to bin 0."""
    return F.greatest(F.lit(0), F.ceil((score - bmin) / w) - 1).cast("int")


def bin_frame(scores: DataFrame, hpts: int = 100, tol: float = 1e-6) -> DataFrame:
    """(aln_id, bmin, w): the bins' origin and width, from the first null's least and largest score."""
    g = scores.groupBy("aln_id").agg(F.min("score").alias("bmin"), F.max("score").alias("bmax"))
    return g.select("aln_id", "bmin", F.greatest((F.col("bmax") - F.col("bmin")) / hpts, F.lit(tol)).alias("w"))


def histogram(scores: DataFrame, frame: DataFrame) -> DataFrame:
    """(aln_id, bin, obs). Histograms of replicates merge by adding obs."""
    return scores.join(frame, "aln_id").groupBy("aln_id", bin_of(F.col("score"), F.col("bmin"), F.col("w")).alias("bin")).agg(F.count(F.lit(1)).alias("obs"))


def merge(*hists: DataFrame) -> DataFrame:
    out = hists[0]
    for h in hists[1:]:
        out = out.unionByName(h)
    return out.groupBy("aln_id", "bin").agg(F.sum("obs").alias("obs"))


def cumulated(hist: DataFrame) -> DataFrame:
    """hist with ``above`` (observations in this bin and higher) and ``nc`` (all of them)."""
    down = W.partitionBy("aln_id").orderBy(F.desc("bin")).rowsBetween(W.unboundedPreceding, 0)
    return hist.withColumn("above", F.sum("obs").over(down)).withColumn("nc", F.sum("obs").over(W.partitionBy("aln_id")))


def tail(hist: DataFrame, pmass: float = 0.05, fracfit: float = 1.0) -> DataFrame:
    """(aln_id, phi_bin, mass, nc): walking down from the highest bin, where the mass reaches ``pmass`` or the share of filled bins ``fracfit``."""
    c = cumulated(hist)
    rank = F.row_number().over(W.partitionBy("aln_id").orderBy(F.desc("bin")))
    filled = F.count(F.lit(1)).over(W.partitionBy("aln_id"))
    stop = c.withColumn("frac", rank / filled).where((F.col("above") / F.col("nc") >= pmass) | (F.col("frac") >= fracfit))
    return stop.groupBy("aln_id").agg(F.max("bin").alias("phi_bin"), F.max_by(F.col("above") / F.col("nc"), "bin").alias("mass"), F.max("nc").alias("nc"))


def fit_exponential(hist: DataFrame, tails: DataFrame, frame: DataFrame) -> DataFrame:
    """(aln_id, phi, mass, lam, nc): binned maximum likelihood of an exponential tail, lam = ln(1 + 1/k) / w with k the mean bin beyond phi.

    With all tail mass in one bin k is 0 and lam null: such alignments fall back on counts.
    """
    d = hist.join(tails, "aln_id").where("bin >= phi_bin").groupBy("aln_id").agg((F.sum(F.col("obs") * (F.col("bin") - F.col("phi_bin"))) / F.sum("obs")).alias("k"))
    d = d.join(tails, "aln_id").join(frame, "aln_id")
    return d.select("aln_id", (F.col("bmin") + F.col("phi_bin") * F.col("w")).alias("phi"), "mass", F.when(F.col("k") > 0, F.log1p(1 / F.col("k")) / F.col("w")).alias("lam"), "nc")


def survival(hist: DataFrame, fit: DataFrame, frame: DataFrame) -> DataFrame:
    """(aln_id, bin, hi, above, nc, surv, survfit): observed share of scores in each bin and above, fitted share beyond the bin's upper end."""
    c = cumulated(hist).join(frame, "aln_id").withColumn("lo", F.col("bmin") + F.col("bin") * F.col("w")).withColumn("hi", F.col("bmin") + (F.col("bin") + 1) * F.col("w"))
    f = fit.select("aln_id", "phi", "mass", "lam")
    return c.join(f, "aln_id").select("aln_id", "bin", "hi", "above", "nc", (F.col("above") / F.col("nc")).alias("surv"), F.when(F.col("lo") >= F.col("phi"), F.col("mass") * F.exp(-F.col("lam") * (F.col("hi") - F.col("phi")))).alias("survfit"))


def _table_bins(hist: DataFrame, hpts: int) -> DataFrame:
    """(aln_id, imin, imax, nb): filled bins and the bins allotted, which grow with the highest."""
    g = hist.groupBy("aln_id").agg(F.min("bin").alias("imin"), F.max("bin").alias("imax"))
    return g.withColumn("nb", F.greatest(F.lit(hpts), F.col("imax") + 1))


def p_values(scores: DataFrame, hist: DataFrame, fit: DataFrame, frame: DataFrame, hpts: int = 100) -> DataFrame:
    """scores with ``pval``, by bins.

    At or beyond phi, where a tail was fitted, it is the fitted share beyond the upper end of the next bin, and from twice the table's bins on that of
    its last bin. Else it is the share of null scores in the score's bin or above; in the two highest filled bins and beyond that is one
    null score, so never 0: a score beyond a null that has one value only gets 1/nc. The step from a bin to the counts above it is an as-of join; it becomes
    a running maximum over the union of both sides, sorted once, so no score meets every bin.
    """
    c = cumulated(hist).select("aln_id", "bin", F.col("above"), F.lit(None).cast("int").alias("i"), F.lit(None).cast("int").alias("j"), F.lit(None).cast("double").alias("score"))
    s = scores.join(frame, "aln_id").select("aln_id", bin_of(F.col("score"), F.col("bmin"), F.col("w")).alias("bin"), F.lit(None).cast("long").alias("above"), "i", "j", "score")
    down = W.partitionBy("aln_id").orderBy(F.desc("bin"), F.col("i").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
    got = c.unionByName(s).withColumn("a", F.max("above").over(down)).where("score IS NOT NULL")
    got = got.join(fit, "aln_id").join(frame, "aln_id").join(_table_bins(hist, hpts), "aln_id")
    end = F.least(F.col("bin") + 2, 2 * F.col("nb"))
    tail_p = F.col("mass") * F.exp(-F.col("lam") * (F.col("bmin") + end * F.col("w") - F.col("phi")))
    fitted = F.col("lam").isNotNull() & ((F.col("score") >= F.col("phi")) | (F.col("bin") >= 2 * F.col("nb") - 1))
    counted = F.when(F.col("bin") >= F.col("imax") - 1, 1).otherwise(F.greatest(F.coalesce("a", F.lit(1)), F.lit(1))) / F.col("nc")
    return got.select("aln_id", "i", "j", "score", F.when(fitted, tail_p).otherwise(counted).alias("pval"))


def score_at(hist: DataFrame, fit: DataFrame, frame: DataFrame, tests: int, threshold: float = 0.05, hpts: int = 100, least_obs: int = 10) -> DataFrame:
    """(aln_id, score): where the E-value of ``tests`` tests comes down to the threshold.

    From the top of the fitted table, with ``least_obs`` observations at least: the lower end of the first bin whose fitted E reaches it. Else from the top of the
    counted one, the upper end of the first bin whose counted E does, or of the bin below the lowest.
    """
    d = fit.join(frame, "aln_id").join(_table_bins(hist, hpts), "aln_id")
    at = F.sequence(F.round((F.col("phi") - F.col("bmin")) / F.col("w")).cast("int"), 2 * F.col("nb") - 1)
    ok = F.filter(at, lambda b: F.col("mass") * F.exp(-F.col("lam") * (F.col("bmin") + (b + 1) * F.col("w") - F.col("phi"))) * tests >= threshold)
    d = d.withColumn("fit_bin", F.when((F.col("nc") >= least_obs) & F.col("lam").isNotNull(), F.array_max(ok)))
    seen = cumulated(hist).where(F.col("above") * tests >= threshold * F.col("nc")).groupBy("aln_id").agg(F.max("bin").alias("seen_bin"))
    d = d.join(seen, "aln_id", "left")
    return d.select("aln_id", F.when(F.col("fit_bin").isNotNull(), F.col("bmin") + F.col("fit_bin") * F.col("w")).otherwise(F.col("bmin") + (F.coalesce("seen_bin", F.col("imin") - 1) + 1) * F.col("w")).alias("score"))


def e_values(pv: DataFrame, contacts: DataFrame, exp_bp: int = 0, two_sets: bool = True) -> DataFrame:
    """pv with ``is_bp`` and ``evalue``: base pairs are one set of tests, all other pairs another; without ``two_sets`` all pairs are one.

    With ``exp_bp`` the first so many hits outside the base pairs, in order of (i, j), count against exp_bp tests only;
    hits are judged by the full set first.
    """
    d = pv.join(contacts.select("aln_id", "i", "j").distinct().withColumn("is_bp", F.lit(True)), ["aln_id", "i", "j"], "left").withColumn("is_bp", F.coalesce("is_bp", F.lit(False)))
    n = d.groupBy("aln_id").agg(F.sum(F.col("is_bp").cast("long")).alias("nb"), F.count(F.lit(1)).alias("nall"))
    d = d.join(n, "aln_id")
    if not two_sets:
        return d.withColumn("evalue", F.col("pval") * F.col("nall")).drop("nb", "nall")
    e = F.when(F.col("is_bp"), F.col("pval") * F.col("nb")).otherwise(F.col("pval") * (F.col("nall") - F.col("nb")))
    if exp_bp:
        w = W.partitionBy("aln_id").orderBy("i", "j").rowsBetween(W.unboundedPreceding, -1)
        early = F.coalesce(F.sum((~F.col("is_bp") & (F.col("pval") * exp_bp < 0.05)).cast("int")).over(w), F.lit(0)) < exp_bp
        e = F.when(F.col("is_bp"), F.col("pval") * F.col("nb")).when(early, F.col("pval") * exp_bp).otherwise(F.col("pval") * (F.col("nall") - F.col("nb")))
    return d.withColumn("evalue", e).drop("nb", "nall")


# Codes of pair types. Below STACKED are base pairs, WWC the canonical kind; below NONE are contacts.
WWC, STACKED, NONE = 0, 12, 14


def pair_mark(bptype: Column, compatible: Column) -> Column:
    """`*` canonical base pair, `**` another, `c~` a contact compatible with the structure, `c` one that isn't, `~` compatible only, blank."""
    return F.when(bptype == WWC, "*").when(bptype < STACKED, "**").when((bptype < NONE) & compatible, "c~").when(bptype < NONE, "c").when(compatible, "~").otherwise(" ")


def null_count(nseq: Column, alen: Column) -> Column:
    """Null replicates of an alignment: 20, 50 below 10**4 cells, 100 below 10**3."""
    cells = nseq.cast("long") * alen
    return F.when(cells < 1000, 100).when(cells < 10_000, 50).otherwise(20)


def fit_gamma(hist: DataFrame, tails: DataFrame, frame: DataFrame) -> DataFrame:
    """(aln_id, phi, mass, mu, lam, tau, nc): a gamma tail from phi on by the moments of the binned scores beyond it.

    mu is phi, the bins' middles are what is averaged; null lam and tau where the tail has no spread.
    """
    d = hist.join(tails, "aln_id").join(frame, "aln_id").where("bin >= phi_bin").withColumn("x", (F.col("bin") - F.col("phi_bin") + 0.5) * F.col("w"))
    g = d.groupBy("aln_id").agg(F.max(F.col("bmin") + F.col("phi_bin") * F.col("w")).alias("phi"), F.max("mass").alias("mass"), F.max("nc").alias("nc"), (F.sum(F.col("obs") * F.col("x")) / F.sum("obs")).alias("m"), (F.sum(F.col("obs") * F.col("x") ** 2) / F.sum("obs")).alias("q"))
    v = F.col("q") - F.col("m") ** 2
    return g.select("aln_id", "phi", "mass", F.col("phi").alias("mu"), F.when(v > 1e-12, F.col("m") / v).alias("lam"), F.when(v > 1e-12, F.col("m") ** 2 / v).alias("tau"), "nc")


def hits(ev: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Pairs with an E-value strictly below the threshold; all of them for a threshold over 1000."""
    return ev if threshold > 1000 else ev.where(F.col("evalue") < threshold)


def summary(ev: DataFrame, threshold: float = 0.05) -> DataFrame:
    """(aln_id, found, true, tp, sen, ppv, f) in percent."""
    sig = (F.col("evalue") < threshold).cast("long")
    g = ev.groupBy("aln_id").agg(F.sum(sig).alias("found"), F.sum(F.col("is_bp").cast("long")).alias("true"), F.sum(sig * F.col("is_bp").cast("long")).alias("tp"))
    return with_rates(g)


def with_rates(g: DataFrame) -> DataFrame:
    sen = F.when(F.col("true") > 0, 100.0 * F.col("tp") / F.col("true")).otherwise(0.0)
    ppv = F.when(F.col("found") > 0, 100.0 * F.col("tp") / F.col("found")).otherwise(0.0)
    g = g.withColumn("sen", sen).withColumn("ppv", ppv)
    return g.withColumn("f", F.when(F.col("sen") + F.col("ppv") > 0, 2 * F.col("sen") * F.col("ppv") / (F.col("sen") + F.col("ppv"))).otherwise(0.0))


def roc(ev: DataFrame) -> DataFrame:
    """(aln_id, score, found, tp, fp, true, neg, sen, ppv, f, evalue): one row for each different score, from the top, by one cumulative pass."""
    g = ev.groupBy("aln_id", "score").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("is_bp").cast("long")).alias("t"), F.max("evalue").alias("evalue"))
    down = W.partitionBy("aln_id").orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, 0)
    all_ = W.partitionBy("aln_id")
    g = g.select("aln_id", "score", F.sum("n").over(down).alias("found"), F.sum("t").over(down).alias("tp"), F.sum("t").over(all_).alias("true"), (F.sum("n").over(all_) - F.sum("t").over(all_)).alias("neg"), "evalue")
    return with_rates(g.withColumn("fp", F.col("found") - F.col("tp")))


def survival_curves(ev: DataFrame) -> DataFrame:
    """(aln_id, curve, score, p): share of scores at or above each score, for base pairs, other pairs and all."""
    d = ev.select("aln_id", F.explode(F.array(F.lit("all"), F.when(F.col("is_bp"), "bp").otherwise("nonbp"))).alias("curve"), "score")
    g = d.groupBy("aln_id", "curve", "score").agg(F.count(F.lit(1)).alias("n"))
    down = W.partitionBy("aln_id", "curve").orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, 0)
    return g.select("aln_id", "curve", "score", (F.sum("n").over(down) / F.sum("n").over(W.partitionBy("aln_id", "curve"))).alias("p"))


def z_scores(scores: DataFrame, contacts: DataFrame) -> DataFrame:
    """(aln_id, i, j, z): each annotated pair against the other scores of its row and of its column, the lesser of both.

    Sums over a column less the pair itself give mean and spread, so nothing is paired again. Null with fewer than two others or no spread.
    """
    mid = scores.groupBy("aln_id").agg(F.avg("score").alias("_mid"))  # sums of squares about the mean keep their figures
    scores = scores.join(mid, "aln_id").select("aln_id", "i", "j", (F.col("score") - F.col("_mid")).alias("score"))
    both = scores.select("aln_id", F.col("i").alias("c"), "score").unionByName(scores.select("aln_id", F.col("j").alias("c"), "score"))
    s = both.groupBy("aln_id", "c").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("s"), F.sum(F.col("score") ** 2).alias("q"))
    d = scores.join(contacts.select("aln_id", "i", "j").distinct(), ["aln_id", "i", "j"])
    for end in "ij":
        d = d.join(s.select("aln_id", F.col("c").alias(end), *(F.col(x).alias(f"{x}{end}") for x in "nsq")), ["aln_id", end])
        n, mean = F.col(f"n{end}") - 1, (F.col(f"s{end}") - F.col("score")) / (F.col(f"n{end}") - 1)
        var = (F.col(f"q{end}") - F.col("score") ** 2 - n * mean**2) / (n - 1)
        d = d.withColumn(f"z{end}", F.when((n > 1) & (var > 1e-12), (F.col("score") - mean) / F.sqrt(var)))
    return d.select("aln_id", "i", "j", F.least("zi", "zj").alias("z"))
