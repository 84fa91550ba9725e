"""A varied subset of each alignment: determinantal greedy selection over composable core-sets.

``choose`` runs the greedy maximisation of a kernel determinant with incremental Cholesky updates: first in parts of an
alignment, whose picks are core-sets, then over the union of the core-sets. ``similar_pairs`` finds the rows that may not both be
chosen: the same selection names a few rows that span the alignment, every row is placed by its distances to them, and only rows
that these distances do not keep apart are compared.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions.sequences import identity_threshold
from strandlake.storage import materialize, release
from strandlake.tables import once

_CODE = np.full(256, 0, np.uint8)
for _c in range(65, 91):
    _CODE[_c] = _CODE[_c + 32] = _c - 64
_CODE[ord("T")] = _CODE[ord("t")] = _CODE[ord("U")]


def encode(rows: list[str]) -> np.ndarray:
    """Rows as a matrix of letter codes, 0 where there is no letter or the row has ended."""
    width = max((len(r) for r in rows), default=0)
    out = np.zeros((len(rows), width), np.uint8)
    for i, r in enumerate(rows):
        b = np.frombuffer(r.encode("latin-1", "replace"), np.uint8)
        out[i, : len(b)] = _CODE[b]
    return out


def matches(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Columns with the same letter, for every row of a and every row of b."""
    w = min(a.shape[1], b.shape[1])
    a, b = a[:, :w], b[:, :w]
    out = np.zeros((len(a), len(b)), np.float32)
    for code in np.intersect1d(np.unique(a), np.unique(b)):
        if code:
            x, y = a == code, b == code
            use = x.any(0) & y.any(0)
            out += x[:, use].astype(np.float32) @ y[:, use].astype(np.float32).T
    return out


def _rows(seqs: DataFrame) -> DataFrame:
    return once(seqs, "seq_id", "aln_id", "aseq", "wgt").where(F.col("aln_id").isNotNull() & F.col("aseq").rlike("[A-Za-z]"))


def _spread_join(seqs: DataFrame, per_aln: DataFrame, salts: int = 16) -> DataFrame:
    """seqs with the columns of per_aln, one row for each alignment: its few rows are repeated under every salt, so a large alignment is in no single task."""
    left = seqs.withColumn("_salt", F.pmod(F.xxhash64("seq_id"), F.lit(salts)).cast("int"))
    right = per_aln.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, ["aln_id", "_salt"]).drop("_salt")


def active_configs(cfg: DataFrame) -> DataFrame:
    """(cfg_id, aln_id, thr, n_want), once for each configuration; thr null where the filter is off."""
    return once(cfg, "cfg_id", "aln_id", "idthresh", "n_want").select("cfg_id", "aln_id", identity_threshold(F.col("idthresh")).alias("thr"), "n_want")


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Columns in which each row of x differs from each row of y, a missing letter being a letter of its own: a metric."""
    w = max(x.shape[1], y.shape[1])
    x, y = (np.pad(m, ((0, 0), (0, w - m.shape[1]))) for m in (x, y))
    return np.stack([(x != r).sum(1) for r in y], axis=1) if len(y) else np.zeros((len(x), 0), np.int64)


def most_apart(a, b, thr: float):
    """Most columns in which rows of a and b letters differ if they are alike by thr: a+b less twice the matches they need."""
    return a + b - 2 * thr * np.minimum(a, b) + 1e-6


def similar_pairs(seqs: DataFrame, cfg: DataFrame, block: int = 512, pivots: int = 8) -> DataFrame:
    """(cfg_id, seq_id_a, seq_id_b): rows of a configuration's alignment alike by its threshold or more.

    The determinantal selection picks ``pivots`` rows of each alignment. A row belongs to the cell of its nearest one; cells are dealt into blocks of
    about ``block`` rows. By the triangle inequality two rows whose distances to some pivot differ by more than alike rows may differ
    are not alike: blocks that are kept apart so never meet, and of others only rows with a possible partner are compared, exactly, by one matrix
    product. So no pair is lost. Rows that are null or without letters take no part, repeated deliveries count
    once; nothing is compared for alignments whose filters are all off.
    """
    seqs = seqs.select("seq_id", "aln_id", "aseq")
    conf = active_configs(cfg).where("thr IS NOT NULL AND aln_id IS NOT NULL")
    need = conf.groupBy("aln_id").agg(F.min("thr").alias("least"))
    rows = once(_spread_join(seqs, need), "seq_id", "aln_id", "aseq", "least").where(F.col("aln_id").isNotNull() & F.col("aseq").rlike("[A-Za-z]"))
    rows = materialize(rows, "rows")
    cand = rows.select("aln_id", F.lit(None).cast("double").alias("thr"), F.lit(pivots).alias("n_want"), "seq_id", "aseq", F.lit(1.0).alias("wgt"))
    chosen = _select(cand, "aln_id", block).select("aln_id", "pick_no", F.col("aseq").alias("pivot"))
    sizes = rows.groupBy("aln_id").agg(F.count(F.lit(1)).alias("n")).withColumn("np", F.ceil(F.col("n") / 4096).cast("int"))
    parts = sizes.select("aln_id", F.explode(F.expr("sequence(0, np - 1)")).alias("part"))

    def place(left: pa.Table, right: pa.Table) -> pa.Table:
        x, y = encode(left["aseq"].to_pylist()), encode(right.sort_by("pick_no")["pivot"].to_pylist())
        far = distances(x, y)
        h = np.concatenate([far, np.zeros((len(x), pivots - far.shape[1]), np.int64)], axis=1).astype(np.int32)
        cell = np.where(left["n"].to_numpy() > block, far.argmin(1), 0) if far.shape[1] else np.zeros(len(x), np.int64)
        h = pa.FixedSizeListArray.from_arrays(pa.array(h.ravel()), pivots).cast(pa.list_(pa.int32()))
        return pa.table({"aln_id": left["aln_id"], "seq_id": left["seq_id"], "aseq": left["aseq"], "least": left["least"], "letters": pa.array((x > 0).sum(1).astype(np.int32)), "cell": pa.array(cell.astype(np.int32)), "h": h})

    left = rows.join(sizes, "aln_id").withColumn("part", F.pmod(F.xxhash64("seq_id"), F.col("np")).cast("int")).select("aln_id", "part", "seq_id", "aseq", "least", "n")
    placed = left.groupBy("aln_id", "part").cogroup(chosen.join(parts, "aln_id").groupBy("aln_id", "part")).applyInArrow(place, "aln_id string, seq_id long, aseq string, least double, letters int, cell int, h array<int>")
    placed = materialize(placed.where("seq_id IS NOT NULL"), "placed")
    salts = placed.groupBy("aln_id", "cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("salts"))
    placed = placed.join(salts, ["aln_id", "cell"]).withColumn("b", F.concat_ws(":", "cell", F.pmod(F.xxhash64("seq_id"), F.col("salts")))).drop("cell", "salts")

    # blocks that can hold alike rows, by the ranges of their rows' distances and letters
    ends = [f(F.col("h")[k]).alias(f"{n}{k}") for k in range(pivots) for n, f in (("lo", F.min), ("hi", F.max))]
    box = placed.groupBy("aln_id", "b").agg(F.max("least").alias("least"), F.min("letters").alias("few"), F.max("letters").alias("many"), *ends)
    other = box.drop("least").toDF("aln_id", *(f"o_{c}" for c in box.columns if c not in ("aln_id", "least")))
    apart = lambda x, y: F.col(x) + F.col(y) - 2 * F.col("least") * F.least(x, y) + 1e-6  # noqa: E731  convex: greatest at a corner
    limit = F.greatest(*(apart(x, y) for x in ("few", "many") for y in ("o_few", "o_many")))
    gap = F.greatest(*(F.greatest(F.col(f"lo{k}") - F.col(f"o_hi{k}"), F.col(f"o_lo{k}") - F.col(f"hi{k}")) for k in range(pivots)), F.lit(0))
    meet = box.join(other, "aln_id").where((F.col("b") <= F.col("o_b")) & (gap <= limit)).select("aln_id", F.col("b").alias("p"), F.col("o_b").alias("q"))
    sides = meet.select("aln_id", F.col("p").alias("b"), "p", "q").unionByName(meet.where("p <> q").select("aln_id", F.col("q").alias("b"), "p", "q"))
    dealt = placed.join(sides, ["aln_id", "b"]).select("aln_id", "p", "q", "b", "seq_id", "aseq", "least", "letters", "h")

    def compare(t: pa.Table) -> pa.Table:
        p, q = t["p"][0].as_py(), t["q"][0].as_py()
        ids, b, count, least = t["seq_id"].to_numpy(), np.array(t["b"].to_pylist()), t["letters"].to_numpy().astype(np.float64), t["least"][0].as_py()
        h = np.array(t["h"].to_pylist(), np.int32)
        i, j = (np.arange(len(ids)),) * 2 if p == q else (np.flatnonzero(b == p), np.flatnonzero(b == q))
        may = np.ones((len(i), len(j)), bool)
        far = most_apart(count[i][:, None], count[j][None, :], least)
        for k in range(h.shape[1]):
            may &= np.abs(h[i, k][:, None] - h[j, k][None, :]) <= far
        if p == q:
            may &= ids[i][:, None] < ids[j][None, :]
        u, v = np.flatnonzero(may.any(1)), np.flatnonzero(may.any(0))
        i, j, may = i[u], j[v], may[np.ix_(u, v)]
        aseq = t["aseq"].combine_chunks()
        x, y = encode(aseq.take(pa.array(i)).to_pylist()), encode(aseq.take(pa.array(j)).to_pylist())
        ident = matches(x, y).astype(np.float64) / np.minimum(count[i][:, None], count[j][None, :])
        u, v = np.nonzero(may & (ident >= least))
        a, c = ids[i[u]], ids[j[v]]
        return pa.table({"aln_id": pa.array([t["aln_id"][0].as_py()] * len(u), pa.string()), "seq_id_a": pa.array(np.minimum(a, c)), "seq_id_b": pa.array(np.maximum(a, c)), "ident": pa.array(ident[u, v])})

    pairs = dealt.groupBy("aln_id", "p", "q").applyInArrow(compare, "aln_id string, seq_id_a long, seq_id_b long, ident double")
    return pairs.join(conf, "aln_id").where("ident >= thr").select("cfg_id", "seq_id_a", "seq_id_b")


def greedy(x: np.ndarray, count: np.ndarray, quality: np.ndarray, thr: float | None, want: int) -> list[int]:
    """Rows chosen one by one, each adding most to log det of the kernel and none alike by thr to one chosen.

    Kernel q_i q_j m_ij / sqrt(c_i c_j): the cosine of one-hot rows, so never indefinite. Each
    step needs one row of the kernel and one column of the Cholesky factor. Ties go to the first row.
    """
    gain = quality.astype(np.float64) ** 2
    chol, chosen, alive = np.zeros((min(want, len(x)), len(x))), [], np.ones(len(x), bool)
    for k in range(min(want, len(x))):
        score = np.where(alive, gain, -1.0)
        j = int(score.argmax())
        if score[j] <= 1e-12 and (not alive[j] or k):
            # a kernel without rank left still offers rows that are not alike
            if not alive.any():
                break
            j = int(np.flatnonzero(alive)[0])
        same = ((x == x[j]) & (x[j] > 0)).sum(1)
        row = quality * quality[j] * same / np.sqrt(count * float(count[j]))
        d = np.sqrt(max(gain[j], 1e-12))
        e = (row - chol[:k].T @ chol[:k, j]) / d
        chol[k] = e
        gain = np.maximum(gain - e**2, 0.0)
        chosen.append(j)
        alive[j] = False
        if thr is not None:
            alive &= ~(same / np.minimum(count, count[j]) >= thr)
    return chosen


def _select(cand: DataFrame, group: str, part: int) -> DataFrame:
    """cand (group, thr, n_want, seq_id, aseq, wgt, ...) -> the picked rows of each group, with pick_no.

    Groups beyond ``part`` rows are chosen from in parts, then from the union of the picks, in as many levels as needed. A part holds at
    least twice what is wanted, and its task a Cholesky factor of n_want times its rows: n_want may be some thousands, not millions.
    """
    names, schema = [*cand.columns, "pick_no"], ", ".join(f"{n} {t}" for n, t in cand.dtypes) + ", pick_no int"

    def pick(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("seq_id", ignore_index=True)
        thr = None if pd.isna(t.thr[0]) else float(t.thr[0])
        x = encode(t.aseq.tolist())
        got = greedy(x, (x > 0).sum(1).astype(float), np.sqrt(t.wgt.to_numpy()), thr, int(t.n_want[0]))
        return t.iloc[got].assign(pick_no=range(1, len(got) + 1))[names]

    for level in range(64):
        # every level halves what is left at least
        n = cand.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.max("n_want").alias("w")).select(group, F.ceil(F.col("n") / F.greatest(F.lit(part), 2 * F.col("w"))).cast("int").alias("np"))
        last = n.where("np > 1").isEmpty()
        c = cand.join(n, group).withColumn("part", F.pmod(F.xxhash64("seq_id", F.lit(level)), F.col("np")))
        out = c.groupBy(group, "part").applyInPandas(lambda k, t: pick(t.drop(columns=["np", "part"])), schema)
        if last:
            return out
        former, cand = cand, materialize(out.drop("pick_no"), "coresets")
        if level:
            release(former)
    raise RuntimeError("core-sets did not shrink")


def choose(seqs: DataFrame, cfg: DataFrame, part: int = 512) -> DataFrame:
    """(cfg_id, aln_id, pick_no, seq_id): at most n_want rows of the configuration's alignment.

    wgt tells how crowded a row's surroundings are: its root is the row's quality; null, NaN and not
    positive count as 1. Alignments beyond ``part`` rows are chosen from in parts, then from the union of the picks, in
    as many levels as needed. A null or not positive n_want gives no rows; a filter that is off forbids
    nothing. Repeated deliveries count once.
    """
    seqs = seqs.select("seq_id", "aln_id", "aseq", "wgt")
    conf = active_configs(cfg).where("aln_id IS NOT NULL AND n_want > 0")
    rows = _rows(_spread_join(seqs, conf.select("aln_id").distinct()))
    cand = rows.join(conf, "aln_id").select("cfg_id", "aln_id", "thr", "n_want", "seq_id", "aseq", F.when((F.col("wgt") > 0) & ~F.isnan("wgt"), F.col("wgt")).otherwise(1.0).alias("wgt"))
    return _select(cand, "cfg_id", part).select("cfg_id", "aln_id", "pick_no", "seq_id")
