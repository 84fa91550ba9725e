"""Joint and marginal residue probabilities of column pairs, and the statistics on them.

Chunks of sequences are counted by matrix products, so no row is made for each pair of residues of each sequence, and
what is summed next is one row for each column pair and chunk. A pair is one row with an array of its 16 joint probabilities: every statistic is then a short expression over arrays.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K = 4
CELLS = [(x, y) for x in range(K) for y in range(K)]
#: Pairs of residues that may pair: Watson-Crick and wobble, by the code sums 3 and 5 (A C G U = 0 1 2 3).
WC_GU = frozenset((x, y) for x, y in CELLS if x + y in (3, 5))
PRIOR = 1e-10


def _grid(cells: DataFrame) -> DataFrame:
    """All column pairs i < j of each alignment, from the list of its columns."""
    cols = cells.groupBy("aln_id").agg(F.sort_array(F.collect_set("col")).alias("c"))
    pair = F.expr("flatten(transform(c, (p, k) -> transform(slice(c, k + 2, size(c)), q -> struct(p as i, q as j))))")
    return cols.select("aln_id", F.explode(pair).alias("p")).select("aln_id", "p.*")


def _products(x: np.ndarray, w: np.ndarray, i: np.ndarray, j: np.ndarray) -> dict[str, np.ndarray]:
    """Weight of every residue pair at the columns i, j of a matrix of codes, by one matrix product for each pair of residues."""
    hot = [(x == k).astype(np.float64) for k in range(K)]
    return {f"w{4 * a + b}": ((hot[a] * w[:, None]).T @ hot[b])[i, j] for a, b in CELLS}


def joint_counts(cells: DataFrame, weights: DataFrame | None = None, chunk: int = 2048) -> DataFrame:
    """(aln_id, i, j, w, total): weight of the sequences with residue x at i and y at j, in the array w at 4x+y.

    weights: (aln_id, seq, wgt), 1 where absent. Only pairs of residues count. Pairs of columns that no sequence has
    residues at have zeros; an alignment of one column has no pairs; an empty table gives none. Chunks of about ``chunk``
    sequences are counted by matrix products and their counts summed, so a large alignment is spread over tasks.
    """
    total = cells.select("aln_id", "seq").distinct()
    total = total.withColumn("wgt", F.lit(1.0)) if weights is None else total.join(weights, ["aln_id", "seq"], "left").fillna(1.0, ["wgt"])
    per = total.groupBy("aln_id").agg(F.sum("wgt").alias("total"), F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("nb"))
    rows = cells.where(F.col("res").between(0, K - 1)).join(per.select("aln_id", "nb"), "aln_id").withColumn("part", F.pmod(F.xxhash64("seq"), F.col("nb")).cast("int"))
    rows = rows.withColumn("wgt", F.lit(1.0)) if weights is None else rows.join(weights, ["aln_id", "seq"], "left").fillna(1.0, ["wgt"])

    def count(t: pa.Table) -> pa.Table:
        seq, first, at = np.unique(t["seq"].to_numpy(), return_index=True, return_inverse=True)
        col, place = np.unique(t["col"].to_numpy(), return_inverse=True)
        x = np.full((len(seq), len(col)), K, np.uint8)
        x[at, place] = t["res"].to_numpy()
        i, j = np.triu_indices(len(col), 1)
        got = _products(x, t["wgt"].to_numpy()[first], i, j)
        n = len(i)
        return pa.table({"aln_id": pa.array([t["aln_id"][0].as_py()] * n, pa.string()), "i": pa.array(col[i].astype(np.int32)), "j": pa.array(col[j].astype(np.int32)), **got})

    wide = ", ".join(f"w{c} double" for c in range(16))
    counts = rows.select("aln_id", "seq", "col", "res", "wgt", "part").groupBy("aln_id", "part").applyInArrow(count, f"aln_id string, i int, j int, {wide}")
    counts = counts.groupBy("aln_id", "i", "j").agg(*(F.sum(f"w{c}").alias(f"w{c}") for c in range(16))).select("aln_id", "i", "j", F.array(*(f"w{c}" for c in range(16))).alias("w"))
    return _grid(cells).join(per.select("aln_id", "total"), "aln_id").join(counts, ["aln_id", "i", "j"], "left").select("aln_id", "i", "j", F.coalesce("w", F.array_repeat(F.lit(0.0), 16)).alias("w"), "total")


def joint_counts_rows(rows: DataFrame, chunk: int = 2048) -> DataFrame:
    """The same from aligned strings (aln_id, seq, aseq, wgt) by matrix products, for many or wide alignments.

    Chunks of an alignment are counted on their own and summed, so one large alignment is spread over tasks. Columns
    count from 1; letters other than A, C, G, U and T are not residues. A null row counts as nothing.
    """
    code = np.full(256, K, np.uint8)
    for k, letters in enumerate(("Aa", "Cc", "Gg", "UuTt")):
        for c in letters:
            code[ord(c)] = k

    def count(t: pa.Table) -> pa.Table:
        text = t["aseq"].to_pylist()
        width = max(map(len, text))
        x = np.full((len(text), width), K, np.uint8)
        for n, s in enumerate(text):
            x[n, : len(s)] = code[np.frombuffer(s.encode("latin-1", "replace"), np.uint8)]
        w = t["wgt"].to_numpy()
        i, j = np.triu_indices(width, 1)
        cols = _products(x, w, i, j)
        n = len(i)
        return pa.table({"aln_id": pa.array([t["aln_id"][0].as_py()] * n, pa.string()), "i": pa.array(i + 1, pa.int32()), "j": pa.array(j + 1, pa.int32()), **cols, "total": pa.array(np.full(n, w.sum()))})

    wide = ", ".join(f"w{c} double" for c in range(16))
    d = rows.where("aseq IS NOT NULL").withColumn("wgt", F.coalesce("wgt", F.lit(1.0)))
    nb = d.groupBy("aln_id").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("nb"), F.max(F.length("aseq")).alias("width"))
    # rows are padded to the alignment's width, so that every chunk has all column pairs
    d = d.join(nb, "aln_id").withColumn("aseq", F.rpad("aseq", F.col("width"), "-")).withColumn("part", F.pmod(F.xxhash64("seq"), F.col("nb")))
    out = d.select("aln_id", "seq", "aseq", "wgt", "part").groupBy("aln_id", "part").applyInArrow(count, f"aln_id string, i int, j int, {wide}, total double")
    out = out.groupBy("aln_id", "i", "j").agg(*(F.sum(c).alias(c) for c in [*(f"w{c}" for c in range(16)), "total"]))
    return out.select("aln_id", "i", "j", F.array(*(f"w{c}" for c in range(16))).alias("w"), "total")


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda x, y: x + y)


def joint(counts: DataFrame, prior: float = PRIOR) -> DataFrame:
    """(aln_id, i, j, nseff, ngap, p): joint probabilities with a prior in each cell; nseff has no prior."""
    d = counts.withColumn("nseff", _sum(F.col("w")))
    return d.select("aln_id", "i", "j", "nseff", (F.col("total") - F.col("nseff")).alias("ngap"), F.transform("w", lambda c: (c + prior) / (F.col("nseff") + 16 * prior)).alias("p"))


def singles(cells: DataFrame, prior: float = 1e-5) -> DataFrame:
    """(aln_id, col, x, p): residue and gap frequencies of a column, with a prior; x = 4 is the gap."""
    total = cells.groupBy("aln_id").agg(F.countDistinct("seq").cast("double").alias("n"))
    seen = cells.where(F.col("res").between(0, K - 1)).groupBy("aln_id", "col").agg(*(F.sum((F.col("res") == x).cast("double")).alias(f"n{x}") for x in range(K)))
    d = cells.select("aln_id", "col").distinct().join(seen, ["aln_id", "col"], "left").fillna(0.0).join(total, "aln_id")
    counts = F.array(*(F.col(f"n{x}") for x in range(K)), F.col("n") - F.col("n0") - F.col("n1") - F.col("n2") - F.col("n3"))
    return d.select("aln_id", "col", "n", F.posexplode(counts).alias("x", "c")).select("aln_id", "col", "x", ((F.col("c") + prior) / (F.col("n") + (K + 1) * prior)).alias("p"))


def marginals(pp: DataFrame) -> DataFrame:
    """(aln_id, col, m): a column's residue probabilities over all its pairs with residues at both ends.

    Not the column's frequencies. A column without such pairs has zeros.
    """
    rows = F.array(*(_sum(F.slice("p", 4 * x + 1, K)) for x in range(K)))
    cols = F.array(*(reduce(add, (F.col("p")[4 * y + x] for y in range(K))) for x in range(K)))
    ends = F.explode(F.array(F.struct(F.col("i").alias("col"), rows.alias("m")), F.struct(F.col("j").alias("col"), cols.alias("m"))))
    d = pp.select("aln_id", "nseff", ends.alias("e")).select("aln_id", "e.col", F.when(F.col("nseff") > 0, F.col("e.m")).otherwise(F.array_repeat(F.lit(0.0), K)).alias("m"))
    s = d.groupBy("aln_id", "col").agg(*(F.sum(F.col("m")[x]).alias(f"m{x}") for x in range(K))).select("aln_id", "col", F.array(*(f"m{x}" for x in range(K))).alias("m"))
    return s.select("aln_id", "col", F.transform("m", lambda v: F.when(_sum(F.col("m")) > 0, v / _sum(F.col("m"))).otherwise(0.0)).alias("m"))


def with_marginals(pp: DataFrame) -> DataFrame:
    """pp with e, the products of the marginals of column i and column j in the order of p, and the marginals a and b."""
    m = marginals(pp)
    a, b = m.select("aln_id", F.col("col").alias("i"), F.col("m").alias("a")), m.select("aln_id", F.col("col").alias("j"), F.col("m").alias("b"))
    return pp.join(a, ["aln_id", "i"]).join(b, ["aln_id", "j"]).withColumn("e", _outer("a", "b"))


def _outer(a: str, b: str) -> Column:
    return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: x * y)))


def _cells(cls: str, allowed=WC_GU) -> Column:
    """Array of (p, e), observed and expected probabilities of the cells of a class."""
    both = F.zip_with("p", "e", lambda p, e: F.struct(p.alias("p"), e.alias("e")))
    if cls == "C16":
        return both
    mask = F.array(*(F.lit(c in allowed) for c in CELLS))
    if cls == "CWC":
        return F.filter(both, lambda c, k: mask[k])
    if cls == "C2":
        part = lambda a, yes: _sum(F.filter(a, lambda c, k: mask[k] == yes))
        return F.array(*(F.struct(part(F.col("p"), yes).alias("p"), part(F.col("e"), yes).alias("e")) for yes in (True, False)))
    raise ValueError(cls)


def _total(cells: Column, term: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(cells, F.lit(0.0), lambda acc, c: acc + term(c["p"], c["e"]))


def _chi(c):
    n = F.col("nseff")
    return _total(c, lambda p, e: F.when(n * e > 0, (n * p - n * e) ** 2 / (n * e)).otherwise(0.0))


def _omes(c):
    n = F.col("nseff")
    return _total(c, lambda p, e: F.when(n * e > 0, (n * p - n * e) ** 2 / n).otherwise(0.0))


def _gt(c):
    n = F.col("nseff")
    return 2 * _total(c, lambda p, e: F.when((n * e > 0) & (n * p > 0), n * p * F.ln(p / e)).otherwise(0.0))


def _mi(c):
    return _total(c, lambda p, e: F.when((p > 0) & (e > 0), p * F.ln(p / e)).otherwise(0.0))


def _entropy(c):
    return -_total(c, lambda p, e: F.when(p > 0, p * F.ln(p)).otherwise(0.0))


def _mir(c):
    return F.when(_entropy(c) > 0.01, _mi(c) / _entropy(c)).otherwise(0.0)


def _mig(c):
    return _mi(c) - F.when(F.col("nseff") > 0, F.col("ngap") / F.col("nseff")).otherwise(0.0)


STATS = {"chi": _chi, "omes": _omes, "gt": _gt, "mi": _mi, "mir": _mir, "mig": _mig}


def select_class(nseq: int, alen: int, nseq_threshold: int = 8, alen_threshold: int = 50) -> str:
    """The pooled class for small alignments, all 16 cells otherwise."""
    return "C2" if nseq <= nseq_threshold or alen <= alen_threshold else "C16"


def covariation(stat: str, cls: str = "C16", allowed=WC_GU) -> Column:
    """Expression of a statistic over the columns of ``with_marginals``; CWC is for gt only."""
    if cls == "CWC" and stat != "gt":
        raise ValueError("only gt sums over allowed cells alone")
    return STATS[stat](_cells(cls, allowed))


def ccf(pp: DataFrame) -> DataFrame:
    """(aln_id, i, j, ccf): norm of the covariances of residue weights about the mean marginal vector."""
    m = marginals(pp).groupBy("aln_id").agg(*(F.sum(F.col("m")[x]).alias(f"s{x}") for x in range(K))).select("aln_id", F.array(*(f"s{x}" for x in range(K))).alias("s"))
    m = m.select("aln_id", F.transform("s", lambda v: F.when(_sum(F.col("s")) > 0, v / _sum(F.col("s"))).otherwise(0.0)).alias("s"))
    d = with_marginals(pp).join(m, "aln_id")
    off = lambda a: F.zip_with(a, "s", lambda x, s: F.col("nseff") * x - s)
    d = d.select("aln_id", "i", "j", off("a").alias("a"), off("b").alias("b"))
    return d.select("aln_id", "i", "j", F.sqrt(F.aggregate(_outer("a", "b"), F.lit(0.0), lambda acc, v: acc + v * v)).alias("ccf"))


def raf(counts: DataFrame, allowed=WC_GU) -> DataFrame:
    """(aln_id, i, j, raf): consistent and compensatory changes among allowed pairs less the share of other sequences.

    Unweighted. From the counts of the allowed pair types: two sequences differ at both ends, at one or at none according to
    their types only, so no sequence meets another.
    """
    types = sorted(allowed)
    c = {t: F.col("w")[4 * t[0] + t[1]] for t in types}
    diff = lambda s, t: (s[0] != t[0]) + (s[1] != t[1])
    change = reduce(add, (c[s] * c[t] * float(diff(s, t)) for k, s in enumerate(types) for t in types[k + 1 :]))
    n = F.col("total")
    good = reduce(add, c.values())
    score = F.when(n > 1, 2 * change / (n * (n - 1))).otherwise(0.0) - (n - good) / n
    return counts.select("aln_id", "i", "j", score.alias("raf"))


def rafs(r: DataFrame) -> DataFrame:
    """(aln_id, i, j, rafs): RAF averaged with its stacked neighbours (i-1, j+1) and (i+1, j-1), absent ones 0; the inner one needs i < j-2."""
    outer = r.select("aln_id", (F.col("i") + 1).alias("i"), (F.col("j") - 1).alias("j"), F.col("raf").alias("out"))
    inner = r.select("aln_id", (F.col("i") - 1).alias("i"), (F.col("j") + 1).alias("j"), F.col("raf").alias("inn"))
    d = r.join(outer, ["aln_id", "i", "j"], "left").join(inner, ["aln_id", "i", "j"], "left")
    inn = F.when(F.col("i") < F.col("j") - 2, F.coalesce("inn", F.lit(0.0))).otherwise(0.0)
    return d.select("aln_id", "i", "j", ((F.coalesce("out", F.lit(0.0)) + 2 * F.col("raf") + inn) / 4).alias("rafs"))


def correct(cov: DataFrame, *values: str, shift: bool = False) -> DataFrame:
    """cov with ``<v>_apc`` and ``<v>_asc``: background corrections by the means of both columns and of all pairs.

    Means are small aggregates joined back, so the pairs are not sorted. ``shift`` makes the corrected values
    start at 0 in every alignment.
    """
    both = cov.select("aln_id", F.explode(F.array("i", "j")).alias("c"), *values)
    per = both.groupBy("aln_id", "c").agg(*(F.avg(v).alias(f"_{v}") for v in values))
    all_ = cov.groupBy("aln_id").agg(*(F.avg(v).alias(f"_{v}_m") for v in values))
    a = per.select("aln_id", F.col("c").alias("i"), *(F.col(f"_{v}").alias(f"_{v}_i") for v in values))
    b = per.select("aln_id", F.col("c").alias("j"), *(F.col(f"_{v}").alias(f"_{v}_j") for v in values))
    d = cov.join(a, ["aln_id", "i"]).join(b, ["aln_id", "j"]).join(all_, "aln_id")
    apc = {f"{v}_apc": F.col(v) - F.when(F.col(f"_{v}_m") != 0, F.col(f"_{v}_i") * F.col(f"_{v}_j") / F.col(f"_{v}_m")).otherwise(F.col(v)) for v in values}
    asc = {f"{v}_asc": F.col(v) - (F.col(f"_{v}_i") + F.col(f"_{v}_j") - F.col(f"_{v}_m")) for v in values}
    d = d.withColumns(apc | asc).drop(*(f"_{v}_{s}" for v in values for s in "ijm"))
    if shift:
        names = [*apc, *asc]
        low = d.groupBy("aln_id").agg(*(F.min(n).alias(f"_{n}") for n in names))
        d = d.join(low, "aln_id").withColumns({n: F.col(n) - F.col(f"_{n}") for n in names}).drop(*(f"_{n}" for n in names))
    return d


def joint_with_gaps(counts: DataFrame, cells: DataFrame, prior: float = PRIOR) -> DataFrame:
    """(aln_id, i, j, p): joint probabilities over residues and the gap as a fifth letter, in the array p at 5x+y.

    A residue opposite a gap is what its column's count leaves after all residues opposite it, so nothing is counted again.
    """
    n = cells.where(F.col("res").between(0, K - 1)).groupBy("aln_id", "col").agg(*(F.sum((F.col("res") == x).cast("double")).alias(f"n{x}") for x in range(K)))
    d = counts
    for end in "ij":
        d = d.join(n.select("aln_id", F.col("col").alias(end), F.array(*(f"n{x}" for x in range(K))).alias(f"n_{end}")), ["aln_id", end], "left")
        d = d.withColumn(f"n_{end}", F.coalesce(f"n_{end}", F.array_repeat(F.lit(0.0), K)))
    w = F.col("w")
    left = [F.col("n_i")[x] - reduce(add, (w[4 * x + y] for y in range(K))) for x in range(K)]
    right = [F.col("n_j")[y] - reduce(add, (w[4 * x + y] for x in range(K))) for y in range(K)]
    none = F.col("total") - _sum(F.col("n_i")) - reduce(add, right)
    c = [x for a in range(K) for x in (*(w[4 * a + b] for b in range(K)), left[a])] + [*right, none]
    return d.select("aln_id", "i", "j", F.transform(F.array(*c), lambda v: (v + prior) / (F.col("total") + 25 * prior)).alias("p"))


def composition(counts: DataFrame) -> DataFrame:
    """(aln_id, i, j, wcf, wobble, noncan, nseff_pct): shares of Watson-Crick, wobble and other pairs, and of the sequences with residues at both ends, in percent."""
    d = counts.withColumn("nseff", _sum(F.col("w")))
    part = lambda sums: F.when(F.col("nseff") > 0, reduce(add, (F.col("w")[4 * x + y] for x, y in sums)) / F.col("nseff")).otherwise(0.0)
    d = d.withColumn("wcf", part([c for c in CELLS if c[0] + c[1] == 3])).withColumn("wobble", part([c for c in CELLS if c[0] + c[1] == 5]))
    return d.select("aln_id", "i", "j", "wcf", "wobble", (1 - F.col("wcf") - F.col("wobble")).alias("noncan"), F.when(F.col("total") > 0, 100 * F.col("nseff") / F.col("total")).otherwise(0.0).alias("nseff_pct"))
