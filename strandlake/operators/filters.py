"""Row and column filters, recoding, weights and shuffles of alignments.

``rows`` are aligned strings (aln_id, seq_id, aseq), one for each sequence; ``cells`` the long form of
``pseudo``. Null or empty strings have no columns and no residues.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strandlake.functions.sequences import n_letters

GAP_RUN = r"[-._]+"


def truncate(cells: DataFrame, start: int, end: int) -> DataFrame:
    """Columns start..end, from 1, inclusive."""
    if not 1 <= start < end:
        raise ValueError("need 1 <= start < end")
    return cells.where(F.col("col").between(start, end))


def long_cells(rows: DataFrame) -> DataFrame:
    """(aln_id, seq_id, col, sym): a row for each character, in upper case, T as U."""
    text = F.translate(F.upper("aseq"), "T", "U")
    return rows.where(F.length("aseq") > 0).select("aln_id", "seq_id", F.posexplode(F.split(text, "")).alias("p", "sym")).where("sym <> ''").select("aln_id", "seq_id", (F.col("p") + 1).cast("int").alias("col"), "sym")


_SYM = np.full(256, 26, np.uint8)  # letters 0..25, other symbols 26, missing data 27
for _c in range(26):
    _SYM[65 + _c] = _SYM[97 + _c] = _c
_SYM[[ord("T"), ord("t")]] = ord("U") - 65
_SYM[ord("~")] = 27


def _symbols(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbol, row and column (from 0) of every character of a string array."""
    text = col.fill_null("").to_pylist()
    n = np.array([len(t) for t in text], np.int64)
    sym = _SYM[np.frombuffer("".join(text).encode("latin-1", "replace"), np.uint8)]
    row = np.repeat(np.arange(len(text)), n)
    return sym, row, np.arange(len(sym)) - np.repeat(np.cumsum(n) - n, n)


def column_counts(rows: DataFrame) -> DataFrame:
    """(aln_id, col, sym, n): characters of each column; sym 0..25 are letters (T as U), 26 gaps and others, 27 missing data.

    Counted batch by batch before any shuffle, so only counts move and a large alignment is no hot key.
    """

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                aln = part.column(0).dictionary_encode()
                sym, row, col = _symbols(part.column(1))
                if not len(sym):
                    continue
                a = aln.indices.to_numpy()[row].astype(np.int64)
                key, n = np.unique((a << 40) | (col << 5) | sym, return_counts=True)
                yield pa.RecordBatch.from_arrays([aln.dictionary.take(pa.array(key >> 40)), pa.array(((key >> 5) & (2**35 - 1)).astype(np.int32) + 1), pa.array((key & 31).astype(np.int32)), pa.array(n.astype(np.int64))], names=["aln_id", "col", "sym", "n"])

    part = rows.select("aln_id", "aseq").where("aln_id IS NOT NULL AND aseq IS NOT NULL").mapInArrow(run, "aln_id string, col int, sym int, n long")
    return part.groupBy("aln_id", "col", "sym").agg(F.sum("n").alias("n"))


def keep_columns(rows: DataFrame, gapthresh: float = 0.5) -> DataFrame:
    """(aln_id, col, i): columns in which residues make up at least 1 - gapthresh; missing data is no evidence.

    col counts from 1 in the alignment given, i from 0 over the kept ones: the map of later results to columns.
    """
    c = column_counts(rows).groupBy("aln_id", "col").agg(F.sum(F.when(F.col("sym") < 26, F.col("n")).otherwise(0)).alias("r"), F.sum(F.when(F.col("sym") < 27, F.col("n")).otherwise(0)).alias("t"))
    kept = c.where((F.col("r") > 0) & (F.col("r") >= (1 - gapthresh) * F.col("t")))
    return kept.select("aln_id", "col", (F.row_number().over(W.partitionBy("aln_id").orderBy("col")) - 1).cast("int").alias("i"))


def keep(residue: np.ndarray, known: np.ndarray, gapthresh: float = 0.5) -> np.ndarray:
    """The rule of ``keep_columns`` on matrices of one alignment: whether a column stays."""
    r, t = (residue & known).sum(0), known.sum(0)
    return (r > 0) & (r >= (1 - gapthresh) * t)


def consensus_columns(aln_cols: DataFrame) -> DataFrame:
    """(aln_id, col) where the consensus (seq_cons, else rf) is no dot."""
    c = F.coalesce("seq_cons", "rf")
    return aln_cols.where(c.isNotNull() & (c != ".")).select("aln_id", "col")


def whole_rows(rows: DataFrame, frac: float = 0.5) -> DataFrame:
    """Rows with more residues than ``frac`` of their alignment's mean: fragments drop out."""
    d = rows.withColumn("len", F.coalesce(n_letters(F.col("aseq")), F.lit(0)))
    mean = d.groupBy("aln_id").agg(F.avg("len").alias("mean"))
    return d.join(mean, "aln_id").where(F.col("len") > frac * F.col("mean")).drop("mean")


def recode(aseq: Column, mode: str = "n") -> Column:
    """Degenerate letters to N or to a gap; missing data to a gap."""
    to = {"n": "N", "gap": "-"}[mode]
    return F.translate(F.regexp_replace(F.translate(F.upper(aseq), "T", "U"), "[B-FH-TV-Z]", to), "~", "-")


def doctor_name(name: Column) -> Column:
    """Brackets to braces, semicolons and inner blanks to underscores."""
    return F.translate(F.trim(name), "([)]; ", "{{}}__")


def unique_names(rows: DataFrame, name: str = "sqname", width: int = 6) -> DataFrame:
    """A name that is repeated in its alignment, or null, gets its place there, zero padded, in front."""
    n = F.count(F.lit(1)).over(W.partitionBy("aln_id", name))
    place = F.row_number().over(W.partitionBy("aln_id").orderBy("seq_id"))
    return rows.withColumn("_n", n).withColumn("_p", place).withColumn("uname", F.when((F.col("_n") > 1) | F.col(name).isNull(), F.concat(F.lpad(F.col("_p").cast("string"), width, "0"), F.lit("_"), F.coalesce(name, F.lit("")))).otherwise(F.col(name))).drop("_n", "_p")


def windows(widths: DataFrame, size: int = 100, slide: int = 50) -> DataFrame:
    """(aln_id, window, first, last) for (aln_id, alen): windows from 1 in steps of ``slide``."""
    return widths.where("alen >= 1").select("aln_id", "alen", F.explode(F.sequence(F.lit(1), F.col("alen"), F.lit(slide))).alias("first")).select("aln_id", ((F.col("first") - 1) / slide).cast("int").alias("window"), "first", F.least(F.col("first") + size - 1, F.col("alen")).alias("last"))


def sample_rows(rows: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """n rows of each alignment without replacement, the same on every run."""
    w = W.partitionBy("aln_id").orderBy(F.md5(F.concat_ws("|", F.lit(seed), "seq_id")), "seq_id")
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def base_composition(rows: DataFrame) -> DataFrame:
    """(aln_id, n_a, n_c, n_g, n_u, n_other): residues of each alignment, without exploding rows."""
    t = F.translate(F.upper(F.coalesce("aseq", F.lit(""))), "T", "U")
    of = lambda x: F.length(t) - F.length(F.translate(t, x, ""))
    parts = [F.sum(of(x)).alias(f"n_{x.lower()}") for x in "ACGU"]
    return rows.groupBy("aln_id").agg(*parts, F.sum(n_letters(t) - of("A") - of("C") - of("G") - of("U")).alias("n_other"))


def msa_stats(rows: DataFrame) -> DataFrame:
    """(aln_id, nseq, alen, mean_len, sd_len, n_runs, mean_run, max_run): sizes and gap runs; sd with n-1."""
    run = F.expr(f"transform(regexp_extract_all(coalesce(aseq, ''), '{GAP_RUN}', 0), x -> length(x))")
    d = rows.select("aln_id", F.coalesce(n_letters(F.col("aseq")), F.lit(0)).alias("len"), F.coalesce(F.length("aseq"), F.lit(0)).alias("w"), run.alias("runs"))
    d = d.select("aln_id", "len", "w", F.size("runs").alias("nr"), F.aggregate("runs", F.lit(0), lambda a, x: a + x).alias("sr"), F.coalesce(F.array_max("runs"), F.lit(0)).alias("mr"))
    g = d.groupBy("aln_id").agg(F.count(F.lit(1)).alias("nseq"), F.max("w").alias("alen"), F.avg("len").alias("mean_len"), F.stddev_samp("len").alias("sd_len"), F.sum("nr").alias("n_runs"), F.sum("sr").alias("s"), F.max("mr").alias("max_run"))
    return g.select("aln_id", "nseq", "alen", "mean_len", F.coalesce("sd_len", F.lit(0.0)).alias("sd_len"), "n_runs", F.when(F.col("n_runs") > 0, F.col("s") / F.col("n_runs")).otherwise(0.0).alias("mean_run"), "max_run")


def pb_weights(rows: DataFrame, chunk: int = 2048) -> DataFrame:
    """(aln_id, seq_id, w): position-based weights, mean 1 in an alignment: columns give 1/(kinds * count of the residue).

    Chunks of an alignment's rows meet its small table of shares; rows without residues have no weight.
    """
    n = column_counts(rows).where("sym < 26")
    k = n.groupBy("aln_id", "col").agg(F.count(F.lit(1)).alias("k"))
    share = n.join(k, ["aln_id", "col"]).select("aln_id", "col", "sym", (1.0 / (F.col("k") * F.col("n"))).alias("s"))
    nb = rows.groupBy("aln_id").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("nb"))
    parts = nb.select("aln_id", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("part"))

    def weigh(left: pa.Table, right: pa.Table) -> pa.Table:
        sym, row, col = _symbols(left["aseq"].combine_chunks())
        width = max(int(col.max()) + 1 if len(col) else 0, int(right["col"].to_numpy().max()) if len(right) else 0)
        table = np.zeros((width + 1, 28))
        table[right["col"].to_numpy() - 1, right["sym"].to_numpy()] = right["s"].to_numpy()
        s = np.bincount(row, table[col, sym], minlength=len(left))
        some = np.bincount(row, sym < 26, minlength=len(left)) > 0
        return pa.table({"aln_id": left["aln_id"].filter(pa.array(some)), "seq_id": left["seq_id"].filter(pa.array(some)), "s": pa.array(s[some])})

    left = rows.where("aln_id IS NOT NULL AND aseq IS NOT NULL").select("aln_id", "seq_id", "aseq").join(nb, "aln_id").withColumn("part", F.pmod(F.xxhash64("seq_id"), F.col("nb")).cast("int")).drop("nb")
    per = left.groupBy("aln_id", "part").cogroup(share.join(parts, "aln_id").groupBy("aln_id", "part")).applyInArrow(weigh, "aln_id string, seq_id long, s double")
    tot = per.groupBy("aln_id").agg(F.sum("s").alias("t"), F.count(F.lit(1)).alias("n"))
    return per.join(tot, "aln_id").select("aln_id", "seq_id", (F.col("s") * F.col("n") / F.col("t")).alias("w"))


def pair_identity(cells: DataFrame, least: float = 0.0, block: int = 512) -> DataFrame:
    """(aln_id, a, b, same, ident): columns where two sequences have the same residue, over the smaller residue count.

    Sequences are dealt into blocks of about ``block``, and every two blocks of an alignment are one matrix product, so that a large one
    spreads over tasks. Pairs below ``least`` stay in their task. Sequences without residues have no pairs.
    """
    c = cells.where(F.col("res") < 4).groupBy("aln_id", "seq").agg(F.collect_list(F.col("col") * 4 + F.col("res")).alias("v"))
    nb = c.groupBy("aln_id").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("nb"))
    d = c.join(nb, "aln_id").withColumn("at", F.pmod(F.xxhash64("seq"), F.col("nb")).cast("int")).withColumn("o", F.explode(F.expr("sequence(0, nb - 1)")))
    d = d.select("aln_id", F.least("at", "o").alias("p"), F.greatest("at", "o").alias("q"), "at", "seq", "v")

    def compare(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        p, q, seq, at = t["p"][0].as_py(), t["q"][0].as_py(), t["seq"].to_numpy(), t["at"].to_numpy()
        v = t["v"].combine_chunks()
        row, flat = np.repeat(np.arange(len(t)), v.value_lengths().to_numpy()), v.flatten().to_numpy()
        col, place = np.unique(flat >> 2, return_inverse=True)
        x = np.full((len(t), len(col)), 4, np.uint8)
        x[row, place] = flat & 3
        i, j = (np.arange(len(t)),) * 2 if p == q else (np.flatnonzero(at == p), np.flatnonzero(at == q))
        same = sum((x[i] == k).astype(np.float32) @ (x[j] == k).astype(np.float32).T for k in range(4))
        n = (x < 4).sum(1)
        ident = same.astype(float) / np.minimum(n[i][:, None], n[j])
        u, w = np.nonzero((ident >= least) & (seq[i][:, None] < seq[j] if p == q else True))
        a, b = seq[i[u]], seq[j[w]]
        return pa.table({"aln_id": pa.array([t["aln_id"][0].as_py()] * len(u), pa.string()), "a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b)), "same": pa.array(same[u, w].astype(np.int64)), "ident": pa.array(ident[u, w])})

    return d.groupBy("aln_id", "p", "q").applyInArrow(compare, "aln_id string, a long, b long, same long, ident double")


def hamming_weights(ident: DataFrame, seqs: DataFrame, thresh: float = 0.2, inclusive: bool = False) -> DataFrame:
    """(aln_id, seq, w): 1 over one more than the others nearer than ``thresh``; ``inclusive`` counts those at it."""
    d = 1 - F.col("ident")
    near = ident.where(d <= thresh if inclusive else d < thresh)
    n = near.select("aln_id", F.col("a").alias("seq")).unionByName(near.select("aln_id", F.col("b").alias("seq"))).groupBy("aln_id", "seq").agg(F.count(F.lit(1)).alias("k"))
    return seqs.join(n, ["aln_id", "seq"], "left").select("aln_id", "seq", (1.0 / (1 + F.coalesce("k", F.lit(0)))).alias("w"))


def _order(seed: int, rep: Column, *key: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), rep, *key))


def shuffle_columns(cells: DataFrame, seed: int = 1, reps: int = 1) -> DataFrame:
    """(aln_id, rep, seq, col, res) with whole columns in another order."""
    cols = cells.select("aln_id", "col").distinct().withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))
    old = W.partitionBy("aln_id", "rep").orderBy("col")
    new = W.partitionBy("aln_id", "rep").orderBy(_order(seed, F.col("rep"), "aln_id", "col"), "col")
    at = cols.withColumn("o", F.row_number().over(old)).withColumn("n", F.row_number().over(new))
    to = at.select("aln_id", "rep", F.col("n").alias("o"), F.col("col").alias("src")).join(at.select("aln_id", "rep", "o", F.col("col").alias("dst")), ["aln_id", "rep", "o"])
    return cells.withColumnRenamed("col", "src").join(to.drop("o"), ["aln_id", "src"]).select("aln_id", "rep", "seq", F.col("dst").alias("col"), "res")


def _permute(cells: DataFrame, within: str, other: str, seed: int, reps: int) -> DataFrame:
    c = cells.where(F.col("res") < 4).withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))
    w = W.partitionBy("aln_id", "rep", within)
    c = c.withColumn("o", F.row_number().over(w.orderBy(other))).withColumn("n", F.row_number().over(w.orderBy(_order(seed, F.col("rep"), "aln_id", within, other), other)))
    to, src = c.select("aln_id", "rep", within, other, "o"), c.select("aln_id", "rep", within, F.col("n").alias("o"), "res")
    return to.join(src, ["aln_id", "rep", within, "o"]).select("aln_id", "rep", "seq", "col", "res")


def shuffle_within_columns(cells: DataFrame, seed: int = 1, reps: int = 1) -> DataFrame:
    """Residues of a column dealt anew to the sequences that have one there; gaps stay."""
    return _permute(cells, "col", "seq", seed, reps)


def shuffle_within_rows(cells: DataFrame, seed: int = 1, reps: int = 1) -> DataFrame:
    """Residues of a sequence dealt anew to its columns; gaps stay."""
    return _permute(cells, "seq", "col", seed, reps)


def cluster_weights(clusters: DataFrame) -> DataFrame:
    """(aln_id, seq, w): every cluster (aln_id, seq, cluster) weighs the same, shared evenly by its members; mean 1 in an alignment."""
    size = clusters.groupBy("aln_id", "cluster").agg(F.count(F.lit(1)).alias("n"))
    per = size.groupBy("aln_id").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("k"))
    return clusters.join(size, ["aln_id", "cluster"]).join(per, "aln_id").select("aln_id", "seq", (F.col("all") / (F.col("k") * F.col("n"))).alias("w"))


def paired_composition(rows: DataFrame, ct: DataFrame) -> DataFrame:
    """(aln_id, paired, n_a, n_c, n_g, n_u): residues in columns that the structure pairs, and in the others."""
    cols = ct.select("aln_id", F.explode(F.array("i", "j")).alias("col")).distinct().withColumn("paired", F.lit(True))
    n = column_counts(rows).join(cols, ["aln_id", "col"], "left").groupBy("aln_id", F.coalesce("paired", F.lit(False)).alias("paired"))
    return n.agg(*(F.sum(F.when(F.col("sym") == ord(x) - 65, F.col("n")).otherwise(0)).alias(f"n_{x.lower()}") for x in "ACGU"))


def same_composition(a: DataFrame, b: DataFrame) -> DataFrame:
    """(aln_id, same) for two lists of rows: whether both have each residue equally often; null where one lacks the alignment."""
    names = [f"n_{x}" for x in ("a", "c", "g", "u", "other")]
    x, y = base_composition(a), base_composition(b).withColumnsRenamed({n: f"{n}_b" for n in names})
    equal = F.lit(True)
    for n in names:
        equal = equal & (F.col(n) == F.col(f"{n}_b"))
    return x.join(y, "aln_id", "full").select("aln_id", equal.alias("same"))


def without_gaps_if_single(rows: DataFrame) -> DataFrame:
    """The row of an alignment of one row without its gaps and missing data; other rows as they are."""
    n = rows.groupBy("aln_id").agg(F.count(F.lit(1)).alias("_n"))
    return rows.join(n, "aln_id").withColumn("aseq", F.when(F.col("_n") == 1, F.regexp_replace("aseq", "[-._~]", "")).otherwise(F.col("aseq"))).drop("_n")


def reordered(rows: DataFrame, *order: Column) -> DataFrame:
    """rows with ``seq_idx``, from 0 in each alignment in the order given and then of seq_id."""
    return rows.withColumn("seq_idx", F.row_number().over(W.partitionBy("aln_id").orderBy(*order, "seq_id")) - 1)


def window_columns(kept: DataFrame, spans: DataFrame) -> DataFrame:
    """(aln_id, window, col): the kept columns of every window; a column looks up its windows by number, without a range join."""
    first = spans.groupBy("aln_id").agg(F.map_from_entries(F.collect_list(F.struct("window", F.struct("first", "last").alias("s")))).alias("w"))
    d = kept.join(first, "aln_id").select("aln_id", "col", F.explode(F.map_entries("w")).alias("e"))
    return d.where((F.col("col") >= F.col("e.value.first")) & (F.col("col") <= F.col("e.value.last"))).select("aln_id", F.col("e.key").alias("window"), "col")


def homology_counts(reference: DataFrame, inferred: DataFrame) -> DataFrame:
    """(aln_id, n_ref, n_inf, n_both): residues written as homologous (upper case) in the reference, in the inferred rows, and in both.

    Rows (aln_id, seq_id, aseq) of both hold the same residues; a residue is known by its place among its row's letters.
    """
    def case(rows, name):
        t = F.regexp_replace("aseq", "[^A-Za-z]", "")
        return rows.where("aseq IS NOT NULL").select("aln_id", "seq_id", F.posexplode(F.filter(F.split(t, ""), lambda c: c != "")).alias("pos", "c")).select("aln_id", "seq_id", "pos", (F.col("c") == F.upper("c")).alias(name))

    j = case(reference, "r").join(case(inferred, "f"), ["aln_id", "seq_id", "pos"])
    return j.groupBy("aln_id").agg(F.sum(F.col("r").cast("long")).alias("n_ref"), F.sum(F.col("f").cast("long")).alias("n_inf"), F.sum((F.col("r") & F.col("f")).cast("long")).alias("n_both"))
