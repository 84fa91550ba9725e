"""Reports over families, motifs and column pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def two_decimals(x: Column) -> Column:
    """A percentage cut, not rounded, to two decimals; a hair is added so that 29.999999999999996 stays 30."""
    return F.floor(x * 100 + 1e-9) / 100


def rank_families(f: DataFrame) -> DataFrame:
    """f (family, found, true, tp, sen, ppv, f, power) with ``band`` of PPV and ``rank`` by falling sensitivity, then power, then name."""
    band = F.when(F.col("ppv") > 95, "high").when(F.col("ppv") > 50, "middle").otherwise("low")
    w = W.orderBy(F.desc("sen"), F.desc("power"), "family")  # one row for each family
    return f.withColumn("band", band).withColumn("rank", F.row_number().over(w))


def segments(f: DataFrame, grey_limit: float = 2.0) -> DataFrame:
    """f with ``segment``: without power, covarying, in the grey zone (none found, few expected), or powerful without covariation."""
    seg = F.when(F.col("power") <= 0, "no power").when(F.col("sen") > 0, "covaries").when(F.col("expected") <= grey_limit, "grey zone").otherwise("power without covariation")
    return f.withColumn("segment", seg)


def compare_structures(a: DataFrame, b: DataFrame) -> DataFrame:
    """(aln_id, only_a, only_b, both, verdict) of two pair lists: better if b adds pairs and loses none, worse the other way round."""
    j = a.select("aln_id", "i", "j").distinct().withColumn("ina", F.lit(1)).join(b.select("aln_id", "i", "j").distinct().withColumn("inb", F.lit(1)), ["aln_id", "i", "j"], "full")
    na, nb = F.col("ina").isNull(), F.col("inb").isNull()
    g = j.groupBy("aln_id").agg(F.sum(nb.cast("long")).alias("only_a"), F.sum(na.cast("long")).alias("only_b"), F.sum((~na & ~nb).cast("long")).alias("both"))
    v = F.when((F.col("only_a") == 0) & (F.col("only_b") == 0), "equal").when(F.col("only_a") == 0, "better").when(F.col("only_b") == 0, "worse").otherwise("different")
    return g.withColumn("verdict", v)


def motif_stats(helices: DataFrame) -> DataFrame:
    """(kind, size, n_helices, n_families, n_pairs) with totals by kind and over all: helices (aln_id, kind, n_pairs) by size class."""
    size = F.when(F.col("n_pairs") < 4, "short").when(F.col("n_pairs") < 6, "middle").otherwise("long")
    g = helices.withColumn("size", size).rollup("kind", "size").agg(F.count(F.lit(1)).alias("n_helices"), F.countDistinct("aln_id").alias("n_families"), F.sum("n_pairs").alias("n_pairs"))
    return g.select(F.coalesce("kind", F.lit("all")).alias("kind"), F.coalesce("size", F.lit("all")).alias("size"), "n_helices", "n_families", "n_pairs")


def apparent_covariation(counts: DataFrame, max_bad: float = 0.6, min_var: int = 1) -> DataFrame:
    """(aln_id, i, j, paired, ts, tv, a_g, u_c): column pairs that are mostly allowed pairs and vary at both ends.

    From joint counts alone. ts and tv count the sequences whose pair differs from the commonest allowed one at an end by a transition or
    a transversion; a_g and u_c are A seen where G rules and U where C rules, at either end.
    """
    ok = [x * 4 + y for x in range(4) for y in range(4) if x + y in (3, 5)]
    w = F.col("w")
    paired = sum((w[c] for c in ok), F.lit(0.0))
    all_ = F.aggregate(w, F.lit(0.0), lambda a, b: a + b)
    left = F.array(*(w[4 * x] + w[4 * x + 1] + w[4 * x + 2] + w[4 * x + 3] for x in range(4)))
    right = F.array(*(w[y] + w[4 + y] + w[8 + y] + w[12 + y] for y in range(4)))
    d = counts.select("aln_id", "i", "j", "w", paired.alias("paired"), all_.alias("n"), left.alias("l"), right.alias("r"))
    d = d.where((F.col("n") > 0) & (F.col("paired") >= (1 - max_bad) * F.col("n")) & (F.col("n") - F.array_max("l") >= min_var) & (F.col("n") - F.array_max("r") >= min_var))
    top = lambda a: F.array_position(a, F.array_max(a)).cast("int") - 1
    d = d.withColumn("tl", top(F.col("l"))).withColumn("tr", top(F.col("r")))
    # a transition changes the code by 2: A<->G, C<->U
    ts = lambda a, t: F.aggregate(F.transform(a, lambda v, k: F.when(F.abs(k - F.col(t)) == 2, v).otherwise(0.0)), F.lit(0.0), lambda s, v: s + v)
    tv = lambda a, t: F.aggregate(F.transform(a, lambda v, k: F.when(F.abs(k - F.col(t)).isin(1, 3), v).otherwise(0.0)), F.lit(0.0), lambda s, v: s + v)
    seen = lambda a, t, rules, x: F.when(F.col(t) == rules, F.col(a)[x]).otherwise(0.0)
    return d.select("aln_id", "i", "j", "paired", (ts(F.col("l"), "tl") + ts(F.col("r"), "tr")).alias("ts"), (tv(F.col("l"), "tl") + tv(F.col("r"), "tr")).alias("tv"), (seen("l", "tl", 2, 0) + seen("r", "tr", 2, 0)).alias("a_g"), (seen("l", "tl", 1, 3) + seen("r", "tr", 1, 3)).alias("u_c"))


def clip_hits(hits: DataFrame, start: int, end: int) -> DataFrame:
    """Hits (sqfrom, sqto from 0) that reach into [start, end], cut to it; either strand."""
    lo, hi = F.least("sqfrom", "sqto"), F.greatest("sqfrom", "sqto")
    return hits.where((hi >= start) & (lo <= end)).withColumn("cfrom", F.greatest(lo, F.lit(start))).withColumn("cto", F.least(hi, F.lit(end)))


def value_histogram(d: DataFrame, value: str, k: int, top: float) -> DataFrame:
    """(bin, n, upto): bins of width 1/k from 0 to ``top`` with clamped ends, and the cumulative share."""
    b = F.least(F.greatest(F.floor(F.col(value) * k), F.lit(0)), F.lit(int(top * k) - 1)).cast("int")
    g = d.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("upto", F.sum("n").over(W.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)) / F.sum("n").over(W.partitionBy(F.lit(1))))


def censored_regression(d: DataFrame, key: str, x: str, y: str, most: float) -> DataFrame:
    """(key, slope, intercept, n) of y on x where x < most; zeros where at most two points or all x are equal."""
    g = d.where(F.col(x) < most).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.regr_slope(y, x).alias("s"), F.regr_intercept(y, x).alias("i"))
    good = (F.col("n") > 2) & F.col("s").isNotNull()
    return g.select(key, F.when(good, F.col("s")).otherwise(0.0).alias("slope"), F.when(good, F.col("i")).otherwise(0.0).alias("intercept"), "n")


def fisher_exact(a: int, b: int, c: int, d: int) -> float:
    """Upper hypergeometric tail of a two by two table, by log-gamma."""
    from math import exp, lgamma

    lf = lambda n: lgamma(n + 1)
    r, s, n = a + b, a + c, a + b + c + d
    base = lf(r) + lf(n - r) + lf(s) + lf(n - s) - lf(n)
    return min(1.0, sum(exp(base - lf(k) - lf(r - k) - lf(s - k) - lf(n - r - s + k)) for k in range(a, min(r, s) + 1) if n - r - s + k >= 0))


def random_pairs(widths: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """(aln_id, k, i, j): n pairs i < j of different columns of each alignment (aln_id, alen) of two columns or more, by hashes, the same on every run."""
    d = widths.where("alen >= 2").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(n))))
    draw = lambda x: F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.lit(x), "aln_id", "k")), 1, 8), 16, 10).cast("long")
    d = d.withColumn("a", F.pmod(draw("a"), F.col("alen")) + 1).withColumn("s", F.pmod(draw("b"), F.col("alen") - 1) + 1)
    d = d.withColumn("b", F.pmod(F.col("a") - 1 + F.col("s"), F.col("alen")) + 1)
    return d.select("aln_id", "k", F.least("a", "b").cast("int").alias("i"), F.greatest("a", "b").cast("int").alias("j"))


def score_split(marked: DataFrame) -> DataFrame:
    """(kind, n, mean, sd, top) of scores by mark: `*`, `**` and `c` are pairs, all others are not; population sd, never below 0."""
    kind = F.when(F.col("mark").isin("*", "**", "c"), "pair").otherwise("other")
    return marked.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("sd"), F.max("score").alias("top"))


def histogram_median(hist: DataFrame, k: int) -> DataFrame:
    """(median): the middle of the last bin of ``value_histogram`` at which at most half lies at or below; null where the first holds more."""
    return hist.where("upto <= 0.5").agg(((F.max("bin") + 0.5) / k).alias("median"))


def pair_summary(helices: DataFrame, pairs: DataFrame) -> DataFrame:
    """(aln_id, n_pairs, n_columns, n_helices, mean_pairs, sd_pairs): size of a structure and of its helices."""
    h = helices.groupBy("aln_id").agg(F.count(F.lit(1)).alias("n_helices"), F.avg("n_pairs").alias("mean_pairs"), F.coalesce(F.stddev_samp("n_pairs"), F.lit(0.0)).alias("sd_pairs"))
    p = pairs.select("aln_id", F.explode(F.array("i", "j")).alias("c")).groupBy("aln_id").agg((F.count(F.lit(1)) / 2).cast("long").alias("n_pairs"), F.countDistinct("c").alias("n_columns"))
    return p.join(h, "aln_id").select("aln_id", "n_pairs", "n_columns", "n_helices", "mean_pairs", "sd_pairs")
