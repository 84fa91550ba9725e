"""Structures: WUSS strings, pairing tables, helices, layers of covarying pairs, folding by simple grammars."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

OPEN, CLOSE = "<([{", ">)]}"


def parse_wuss(ss: str | None) -> list[tuple[int, int, str]]:
    """(i, j, layer) of the pairs of a WUSS string, columns from 1: one stack per bracket kind and per letter.

    Brackets nest and form layer "nested"; upper-case letters open and lower-case letters close pseudoknots, each its own layer.
    A symbol without a partner is unpaired.
    """
    stacks: dict[str, list[int]] = {}
    out = []
    for k, c in enumerate(ss or "", 1):
        if c in OPEN:
            stacks.setdefault(c, []).append(k)
        elif c in CLOSE:
            s = stacks.get(OPEN[CLOSE.index(c)])
            if s:
                out.append((s.pop(), k, "nested"))
        elif "A" <= c <= "Z":
            stacks.setdefault(c, []).append(k)
        elif "a" <= c <= "z" and stacks.get(c.upper()):
            out.append((stacks[c.upper()].pop(), k, "pk" + c.upper()))
    return sorted(out)


def to_wuss(pairs: list[tuple[int, int, str]], width: int) -> str:
    """The string again: nested pairs as <>, the other layers as letters in order."""
    out, letters = [":"] * width, {}
    for i, j, layer in sorted(pairs):
        if layer == "nested":
            a, b = "<", ">"
        else:
            if layer not in letters and len(letters) == 26:
                raise ValueError("a WUSS string has letters for 26 layers")
            a = letters.setdefault(layer, chr(65 + len(letters)))
            b = a.lower()
        out[i - 1], out[j - 1] = a, b
    return "".join(out)


def wuss_pairs(structures: DataFrame) -> DataFrame:
    """(aln_id, layer, i, j) for (aln_id, ss)."""

    def f(it):
        for t in it:
            yield pd.DataFrame([(a, layer, i, j) for a, ss in zip(t.aln_id, t.ss) for i, j, layer in parse_wuss(ss)], columns=["aln_id", "layer", "i", "j"])

    return structures.select("aln_id", "ss").where("ss IS NOT NULL").mapInPandas(f, "aln_id string, layer string, i int, j int")


def pairs_wuss(ct: DataFrame, widths: DataFrame) -> DataFrame:
    """(aln_id, ss) from pairs (aln_id, layer, i, j) and (aln_id, alen); no pairs give an unpaired string."""
    g = ct.groupBy("aln_id").agg(F.collect_list(F.struct("i", "j", "layer")).alias("p"))

    @F.pandas_udf("string")
    def f(p: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([to_wuss([(x["i"], x["j"], x["layer"]) for x in ([] if q is None else q)], int(w)) for q, w in zip(p, n)])

    return widths.join(g, "aln_id", "left").select("aln_id", f("p", "alen").alias("ss"))


def repair_pairs(ct: DataFrame, kept: DataFrame) -> DataFrame:
    """Pairs of which both columns were kept, in the new places: (aln_id, layer, i, j) with i, j from 0."""
    a, b = kept.select("aln_id", F.col("col").alias("ci"), F.col("i").alias("ni")), kept.select("aln_id", F.col("col").alias("cj"), F.col("i").alias("nj"))
    return ct.withColumnsRenamed({"i": "ci", "j": "cj"}).join(a, ["aln_id", "ci"]).join(b, ["aln_id", "cj"]).select("aln_id", "layer", F.col("ni").alias("i"), F.col("nj").alias("j"))


def helices(ct: DataFrame, max_unpaired: int = 2) -> DataFrame:
    """(aln_id, layer, helix, n_pairs, i_out, j_out, i_in, j_in): stacked pairs with at most ``max_unpaired`` unpaired columns between two of them.

    Gaps and islands over pairs in order of i: a new helix begins where either side jumps too far or turns.
    """
    w = W.partitionBy("aln_id", "layer").orderBy("i")
    step = F.col("i") - F.lag("i").over(w) - 1 + F.lag("j").over(w) - F.col("j") - 1
    breaks = F.lag("i").over(w).isNull() | (F.lag("j").over(w) <= F.col("j")) | (step > max_unpaired)
    d = ct.withColumn("_b", breaks.cast("int")).withColumn("helix", F.sum("_b").over(w.rowsBetween(W.unboundedPreceding, 0)))
    g = d.groupBy("aln_id", "layer", "helix").agg(F.count(F.lit(1)).alias("n_pairs"), F.min("i").alias("i_out"), F.max("j").alias("j_out"), F.max("i").alias("i_in"), F.min("j").alias("j_in"))
    return g.select("aln_id", "layer", F.col("helix").cast("int").alias("helix"), "n_pairs", "i_out", "j_out", "i_in", "j_in")


def compatible(pairs: DataFrame, ct: DataFrame) -> DataFrame:
    """Pairs (aln_id, i, j) neither end of which is paired in any layer."""
    used = ct.select("aln_id", F.explode(F.array("i", "j")).alias("c")).distinct()
    return pairs.join(used.withColumnRenamed("c", "i"), ["aln_id", "i"], "left_anti").join(used.withColumnRenamed("c", "j"), ["aln_id", "j"], "left_anti").select(*pairs.columns)


def label(spair: DataFrame, contacts: DataFrame) -> DataFrame:
    """spair with the contact's type; the first type in alphabet order where a pair has several."""
    c = contacts.groupBy("aln_id", "i", "j").agg(F.min("cttype").alias("cttype"))
    return spair.join(c, ["aln_id", "i", "j"], "left")


# ---- nested layers of covarying pairs --------------------------------------------------------


def _nested(width: int, score: dict[tuple[int, int], float]) -> list[tuple[int, int]]:
    """The nested set of pairs of the greatest total score; of equal ones the one that pairs leftmost columns."""
    best = np.zeros((width + 2, width + 2))
    by_i: dict[int, list[tuple[int, float]]] = {}
    for (i, j), s in score.items():
        by_i.setdefault(i, []).append((j, s))
    for i in range(width, 0, -1):
        row = best[i + 1].copy()
        for j, s in sorted(by_i.get(i, ())):
            inner = best[i + 1, j - 1] if j - 1 >= i + 1 else 0.0
            tail = np.zeros(width + 2)
            if j + 1 <= width:
                tail[j + 1 :] = best[j + 1, j + 1 :]
            row[j:] = np.maximum(row[j:], s + inner + tail[j:])
        best[i] = row
    out, stack = [], [(1, width)]
    while stack:
        i, j = stack.pop()
        if i >= j:
            continue
        for k, s in sorted(by_i.get(i, ())):
            if k <= j:
                inner = best[i + 1, k - 1] if k - 1 >= i + 1 else 0.0
                tail = best[k + 1, j] if k + 1 <= j else 0.0
                if s + inner + tail >= best[i, j] - 1e-9:
                    out.append((i, k))
                    stack += [(i + 1, k - 1), (k + 1, j)]
                    break
        else:
            stack.append((i + 1, j))
    return sorted(out)


def layers(pairs: list[tuple[int, int, float]], threshold: float) -> list[list[tuple[int, int]]]:
    """Nested layers, by falling score -ln E + ln threshold + 0.1, until every pair with E below the threshold is in one."""
    left = {(i, j): -np.log(max(e, 1e-300)) + np.log(threshold) + 0.1 for i, j, e in pairs if e < threshold}
    out = []
    while left:
        ends = sorted({c for p in left for c in p})
        at = {c: k for k, c in enumerate(ends, 1)}  # only paired columns matter for nesting
        got = [(ends[i - 1], ends[j - 1]) for i, j in _nested(len(ends), {(at[i], at[j]): s for (i, j), s in left.items()})]
        out.append(got)
        for p in got:
            del left[p]
    return out


def max_covariation(spair: DataFrame, threshold: float = 0.05) -> DataFrame:
    """(aln_id, layer, i, j) from (aln_id, i, j, evalue): layers from 1, each nested. Only significant pairs reach Python."""

    def f(t: pd.DataFrame) -> pd.DataFrame:
        got = layers(list(zip(t.i, t.j, t.evalue)), threshold)
        return pd.DataFrame([(t.aln_id.iloc[0], n, int(i), int(j)) for n, p in enumerate(got, 1) for i, j in p], columns=["aln_id", "layer", "i", "j"])

    return spair.where(F.col("evalue") < threshold).select("aln_id", "i", "j", "evalue").groupBy("aln_id").applyInPandas(f, "aln_id string, layer int, i int, j int")


def excluded(layered: DataFrame) -> DataFrame:
    """(aln_id, layer, i, j): for every layer the significant pairs of the other layers, which must stay unpaired there."""
    n = layered.select("aln_id", F.col("layer").alias("at")).distinct()
    return layered.join(n, "aln_id").where("layer <> at").select("aln_id", F.col("at").alias("layer"), "i", "j")


# ---- grammars --------------------------------------------------------------------------------


def one_hot(seq: str) -> np.ndarray:
    """Rows of residue probabilities: Y and R split in two, other degenerate letters spread evenly, T as U."""
    table = {"A": (1, 0, 0, 0), "C": (0, 1, 0, 0), "G": (0, 0, 1, 0), "U": (0, 0, 0, 1), "T": (0, 0, 0, 1), "R": (0.5, 0, 0.5, 0), "Y": (0, 0.5, 0, 0.5)}
    return np.array([table.get(c, (0.25,) * 4) for c in seq.upper()], float).reshape(-1, 4)


def _emit(seq: str, single: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = one_hot(seq)
    return x @ single, x @ pair @ x.T


def _scaled(run, x: np.ndarray, n: int) -> tuple[float, object]:
    """ln P from ``run(scale)``, which multiplies every letter's emission by ``scale`` so that tables stay in a double's range.

    The scale comes from the first letters and is moved until the whole is neither 0 nor infinite. Returns ln P and run's tables.
    """
    scale = 4.0
    for part in (min(n, 60), min(n, 400), n):
        low, high = 0.0, np.inf
        for _ in range(200):
            p, tables = run(part, scale)
            if np.isfinite(p) and p > 0:
                break
            if p == 0:  # too small, or no parse at all
                low = scale
            else:
                high = scale
            scale = scale * 1.5 if high == np.inf else (low + high) / 2
            if scale > 1e6:
                return -np.inf, tables
        else:
            return -np.inf, tables
        log = float(np.log(p) - part * np.log(scale))
        if part < n:
            scale = float(np.exp(-log / part))
    return log, tables


def _rows_g5(e1: np.ndarray, e2: np.ndarray, t: tuple[float, float, float]) -> np.ndarray:
    """s[i, j] for the letters i..j-1; a row needs one vector-matrix product with the rows below it."""
    n = len(e1)
    s = np.zeros((n + 1, n + 1))
    s[n, n] = t[2]
    with np.errstate(over="ignore", invalid="ignore"):
        for i in range(n - 1, -1, -1):
            s[i] = t[0] * e1[i] * s[i + 1]
            if i + 1 < n:
                s[i, i + 2 :] += t[1] * ((e2[i, i + 1 :] * s[i + 1, i + 1 : n]) @ s[i + 2 :, i + 2 :])
            s[i, i] = t[2]
    return s


def inside_g5(seq: str, t: tuple[float, float, float], single: np.ndarray, pair: np.ndarray) -> float:
    """ln P(seq) under S -> a S | a S b S | end, with rule probabilities t; finite at any length."""
    n = len(seq)
    e1, e2 = _emit(seq, single, pair)

    def run(m, c):
        s = _rows_g5(e1[:m] * c, e2[:m, :m] * c * c, t)
        return s[0, m], s

    return _scaled(run, e1, n)[0] if n else float(np.log(t[2]))


#: Columns of a block of G5's tables; cells that the tables of sequences filled together have at most.
_BLOCK, _TOGETHER = 32, 1 << 20


def _blocks_g5(e1: np.ndarray, e2: np.ndarray, t: tuple[float, float, float]) -> tuple[np.ndarray, np.ndarray]:
    """(s, v) for sequences of m whole blocks: s[r, i, j] for the letters i..j-1 of sequence r, and v, with which s[r, i] = v[r, i] @ s[r].

    e1 [r, n] and e2 [r, n, n] are zero beyond a sequence's end. All blocks of one diagonal are filled together, row by row from
    below; what lies between a block's rows and columns comes in by products of blocks.
    """
    r, n = e1.shape
    b, m = _BLOCK, n // _BLOCK
    s, v = np.zeros((r, n, n)), np.zeros((r, n, n))  # the letters end before n: column n is that of a padded place
    k = np.arange(n)
    s[:, k, k] = t[2]
    v[:, k[:-1], k[1:]] = t[0] * e1[:, :-1]
    s4, v4, e4 = (x.reshape(r, m, b, m, b) for x in (s, v, e2))
    for d in range(m):
        at = np.arange(m - d)
        c = np.zeros((r, m - d, b, b))
        if d > 1:
            for i in at:
                c[:, i] = v[:, i * b : (i + 1) * b, (i + 1) * b : (i + d) * b] @ s[:, (i + 1) * b : (i + d) * b, (i + d) * b : (i + d + 1) * b]
        own, end = v4[:, at, :, at].swapaxes(0, 1), s4[:, at + d, :, at + d].swapaxes(0, 1)
        here, step = (x[:, at, :, at + d].swapaxes(0, 1).copy() for x in (s4, v4))
        pair = e4[:, at, :, at + d].swapaxes(0, 1)
        # s of the row below a row, one column before: what a pair encloses
        left = s4[:, at, :, at + d - 1, b - 1].swapaxes(0, 1) if d else np.zeros((r, m, b))
        last = np.zeros((r, m - d, b))
        if d:
            last[:, :, 1:] = s4[:, at + 1, 0, at + d, : b - 1]
            last[:, :, 0] = s4[:, at + 1, 0, at + d - 1, b - 1]
        for i in range(b - 1, -1, -1):
            if i == b - 1:
                inner = last
            else:
                inner = np.empty_like(last)
                inner[:, :, 1:], inner[:, :, 0] = here[:, :, i + 1, : b - 1], left[:, :, i + 1]
            # the letter that pairs with i stands before column j
            before = np.empty_like(last)
            before[:, :, 1:] = pair[:, :, i, : b - 1]
            before[:, :, 0] = e4[:, at, i, at + d - 1, b - 1] if d else 0
            v_row = t[1] * before * inner
            if d == 0:
                v_row[:, :, : i + 2] = 0
            elif d == 1 and i == b - 1:
                v_row[:, :, 0] = 0
            step[:, :, i] += v_row
            row = c[:, :, i] + (step[:, :, i, None] @ (here if d == 0 else end))[:, :, 0]
            if d:
                row += (own[:, :, i, None, i + 1 :] @ here[:, :, i + 1 :])[:, :, 0]
            here[:, :, i] += row
        s4[:, at, :, at + d], v4[:, at, :, at + d] = here.swapaxes(0, 1), step.swapaxes(0, 1)
    return s, v


def _posteriors_g5(e2: np.ndarray, s: np.ndarray, v: np.ndarray, n: np.ndarray, t: tuple[float, float, float]) -> np.ndarray:
    """p[r, i, j]: probability that i pairs with j - 1, from the tables of ``_blocks_g5`` for sequences of n letters; from the largest spans to the smallest."""
    r, wide, _ = s.shape
    b, m = _BLOCK, wide // _BLOCK
    o, a = np.zeros_like(s), np.zeros_like(s)  # how ln P moves with s, and with v
    o[np.arange(r), 0, n] = 1 / s[np.arange(r), 0, n]
    o4, a4, s4, v4, e4 = (x.reshape(r, m, b, m, b) for x in (o, a, s, v, e2))
    for d in range(m - 1, -1, -1):
        at = np.arange(m - d)
        here = o4[:, at, :, at + d].swapaxes(0, 1).copy()
        of_v = np.zeros((r, m - d, b, b))
        for i in at:
            j = slice((i + d) * b, (i + d + 1) * b)
            rows = slice(i * b, (i + 1) * b)
            if i:
                here[:, i] += v[:, : i * b, rows].swapaxes(1, 2) @ o[:, : i * b, j]
            if i + d + 1 < m:
                of_v[:, i] = o[:, rows, j.stop :] @ s[:, j, j.stop :].swapaxes(1, 2)
        own, end = (x.transpose(1, 0, 3, 2).copy() for x in (v4[:, at, :, at], s4[:, at + d, :, at + d]))
        pair = e4[:, at, :, at + d].swapaxes(0, 1)
        right = np.zeros((r, m - d, b))  # how ln P moves with v one column beyond the block
        right[:, :-1] = a4[:, at[:-1], :, at[:-1] + d + 1, 0].swapaxes(0, 1)
        for i in range(b):
            # a pair (i - 1, j) encloses s[i, j]
            w = np.zeros((r, m - d, b))
            if i:
                w[:, :, :-1], w[:, :, -1] = of_v[:, :, i - 1, 1:], right[:, :, i - 1]
                w *= pair[:, :, i - 1]
            else:
                k = at[1:]
                w[:, 1:, :-1] = a4[:, k - 1, b - 1, k + d, 1:]
                w[:, 1:-1, -1] = a4[:, k[:-1] - 1, b - 1, k[:-1] + d + 1, 0]
                w[:, 1:] *= e4[:, k - 1, b - 1, k + d]
            if d == 0:
                w[:, :, :i] = 0  # a pair's ends differ
            here[:, :, i] += t[1] * w
            if i:
                here[:, :, i] += (own[:, :, i, None, :i] @ here[:, :, :i])[:, :, 0]
            if d == 0:
                here[:, :, i, :i] = 0
            of_v[:, :, i] += (here[:, :, i, None] @ end)[:, :, 0]
        o4[:, at, :, at + d], a4[:, at, :, at + d] = here.swapaxes(0, 1), of_v.swapaxes(0, 1)
    a *= v
    k = np.arange(wide - 1)
    a[:, k, k + 1] = 0
    return a


def posteriors_g5(seqs: list[str], t: tuple[float, float, float], single: np.ndarray, pair: np.ndarray) -> list[np.ndarray]:
    """Posterior probability of every pair (i, k) of each sequence under G5, the sequences filled together; best of like lengths."""
    n = np.array([len(x) for x in seqs])
    wide = (int(n.max(initial=0)) // _BLOCK + 1) * _BLOCK  # a column more than letters
    e1, e2 = np.zeros((len(seqs), wide)), np.zeros((len(seqs), wide, wide))
    for k, x in enumerate(seqs):
        e1[k, : n[k]], e2[k, : n[k], : n[k]] = _emit(x, single, pair)

    def tables(rows, part, c):
        w = (int(part.max()) // _BLOCK + 1) * _BLOCK
        c = c[:, None] * (np.arange(w) < part[:, None])
        with np.errstate(over="ignore", invalid="ignore"):
            x = e2[rows, :w, :w] * c[:, :, None] * c[:, None]
            s, v = _blocks_g5(e1[rows, :w] * c, x, t)
        return s[np.arange(len(rows)), 0, part], x, s, v

    out = [np.zeros((k, k)) for k in n]
    rows = np.flatnonzero(n > 0)
    scale = np.full(len(rows), 4.0)
    for top in (60, wide) if wide > 500 else (wide,):
        if not len(rows):
            return out
        part = np.minimum(n[rows], top)
        p, x, s, v = tables(rows, part, scale)
        fine = np.isfinite(p) & (p > 0)
        for k in rows[~fine]:  # its scale has to be looked for
            found = {}

            def run(length, c, k=k):
                found["c"] = c
                p, *kept = tables(np.array([k]), np.array([length]), np.array([c]))
                return p[0], kept

            if np.isfinite(_scaled(run, e1[k], int(n[k]))[0]):
                one = tables(np.array([k]), n[k : k + 1], np.array([found["c"]]))
                out[k] = _posteriors_g5(*one[1:], n[k : k + 1], t)[0, : n[k], 1 : n[k] + 1]
        rows, part, scale, p, s, v, x = rows[fine], part[fine], scale[fine], p[fine], s[fine], v[fine], x[fine]
        if top < wide:
            scale = scale * p ** (-1 / part)
    if len(rows):
        post = _posteriors_g5(x, s, v, n[rows], t)
        for k, q in zip(rows, post):
            out[k] = q[: n[k], 1 : n[k] + 1]
    return out


def outside_g5(seq: str, t: tuple[float, float, float], single: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Posterior probability of every pair (i, k) under G5."""
    return posteriors_g5([seq], t, single, pair)[0]


def inside_g6(seq: str, t: dict[str, tuple[float, ...]], single: np.ndarray, pair: np.ndarray, stack: np.ndarray | None = None, bifurcation_free_end: bool = False) -> float:
    """ln P(seq) under S -> L S | L, L -> a F a' | a, F -> a F a' | L S; finite at any length that has a parse.

    ``stack`` [16, 16] makes pairs inside a helix depend on the one outside (G6S). With ``bifurcation_free_end`` the
    variant S -> L S | end, L -> a F a' | a a' | a, F -> a F a' | a a' | L S is meant (G6X, and with stack G6XS).
    A row of each table is one vector-matrix product.
    """
    n = len(seq)
    x = one_hot(seq)
    e1, e2 = _emit(seq, single, pair)
    inner = None
    if stack is not None:
        pr = np.einsum("ia,jb->ijab", x, x).reshape(n, n, 16)
        inner = np.zeros((n, n))  # the pair (i, j) given the one around it
        inner[1:, :-1] = np.einsum("ijp,ijp->ij", pr[:-1, 1:] @ stack, pr[1:, :-1])
        inner[0], inner[:, -1] = e2[0], e2[:, -1]
    free = bifurcation_free_end

    def run(m, c):
        a1, a2 = e1[:m] * c, e2[:m, :m] * c * c
        a3 = a2 if inner is None else np.where((np.arange(m)[:, None] > 0) & (np.arange(m)[None, :] < m - 1), inner[:m, :m], e2[:m, :m]) * c * c
        S, below = np.zeros((m + 1, m + 1)), np.zeros(m + 1)  # below: row i+1 of F
        if free:
            S[m, m] = t["S"][1]
        with np.errstate(over="ignore", invalid="ignore"):
            for i in range(m - 1, -1, -1):
                L, Fr = np.zeros(m + 1), np.zeros(m + 1)
                j = np.arange(i + 3, m + 1)
                L[j] = t["L"][0] * a2[i, j - 1] * below[j - 1]
                Fr[j] = t["F"][0] * a3[i, j - 1] * below[j - 1]
                if free and i + 2 <= m:
                    L[i + 2] += t["L"][1] * a2[i, i + 1]
                    Fr[i + 2] += t["F"][1] * a3[i, i + 1]
                L[i + 1] = t["L"][-1] * a1[i]
                split = L[i + 1 :] @ S[i + 1 :]
                S[i] = t["S"][0] * split + (0 if free else t["S"][1] * L)
                if free:
                    S[i, i] = t["S"][1]
                below = Fr + t["F"][-1] * split
        return S[0, m], S

    return _scaled(run, e1, n)[0] if n else (float(np.log(t["S"][1])) if free else -np.inf)


def mea_pairs(post: np.ndarray, gamma: float = 1.0) -> list[tuple[int, int]]:
    """The nested pairs of the greatest expected accuracy: posterior sums weighted against staying unpaired; columns from 1."""
    free = 1 - post.sum(0) - post.sum(1)
    gain = 2 * gamma * post - free[:, None] - free
    i, j = np.nonzero((post > 0.01) & (gain > 0))
    score = {(a + 1, b + 1): g for a, b, g in zip(i.tolist(), j.tolist(), gain[i, j].tolist()) if a < b}
    return _nested(len(post), score) if score else []


#: Rule probabilities of the built-in parameter sets: the transitions of each nonterminal in the order of its rules.
RULES = {"g5": (0.4, 0.2, 0.4), "g6": {"S": (0.6, 0.4), "L": (0.3, 0.7), "F": (0.6, 0.4)}, "g6x": {"S": (0.6, 0.4), "L": (0.2, 0.1, 0.7), "F": (0.5, 0.1, 0.4)}}


def emissions(canonical: float = 0.9) -> tuple[np.ndarray, np.ndarray]:
    """(single, pair): even letters; Watson-Crick and wobble pairs share ``canonical``, the other ten the rest."""
    pair = np.full((4, 4), (1 - canonical) / 10)
    for a in range(4):
        for b in range(4):
            if a + b in (3, 5):
                pair[a, b] = canonical / 6
    return np.full(4, 0.25), pair


def _letters(a: str | None) -> str:
    return "".join(c for c in (a or "").upper() if c.isalpha())


def inside(seqs: DataFrame, grammar: str = "g5", canonical: float = 0.375) -> DataFrame:
    """(seq_id, logp) for (seq_id, aseq) under g5, g6, g6s, g6x or g6xs; rows without residues give null. Cubic in the length, in numpy products."""
    single, pair = emissions(canonical)
    stack = np.tile(pair.ravel(), (16, 1)) if grammar.endswith("s") else None
    rules = RULES[grammar.removesuffix("s")]

    @F.pandas_udf("double")
    def f(s: pd.Series) -> pd.Series:
        out = []
        for r in map(_letters, s):
            if not r:
                out.append(None)
            elif grammar == "g5":
                out.append(inside_g5(r, rules, single, pair))
            else:
                out.append(inside_g6(r, rules, single, pair, stack, "x" in grammar))
        return pd.Series(out, dtype=float)

    return seqs.select("seq_id", f("aseq").alias("logp"))


def fold(seqs: DataFrame, gamma: float = 1.0, canonical: float = 0.9) -> DataFrame:
    """(seq_id, i, j): pairs of greatest expected accuracy under G5 posteriors for (seq_id, aseq); i and j count residues from 1."""
    single, pair = emissions(canonical)

    def f(it):
        for t in it:
            text = sorted(((r, k) for k, r in zip(t.seq_id, map(_letters, t.aseq)) if len(r) > 1), key=lambda x: len(x[0]))
            rows, at = [], 0
            while at < len(text):  # like lengths together; the longest one counts
                n = 1
                while at + n < len(text) and (n + 1) * len(text[at + n][0]) ** 2 <= _TOGETHER:
                    n += 1
                some, at = text[at : at + n], at + n
                for (_, k), post in zip(some, posteriors_g5([r for r, _ in some], RULES["g5"], single, pair)):
                    rows += [(k, i, j) for i, j in mea_pairs(post, gamma)]
            yield pd.DataFrame(rows, columns=["seq_id", "i", "j"])

    return seqs.select("seq_id", "aseq").mapInPandas(f, "seq_id long, i int, j int")


def expected_rules(seq: str, t: tuple[float, float, float], single: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Expected uses of the three rules of G5 in the parses of a sequence; an end comes after every single and twice for every pair, once more in all."""
    pairs = float(outside_g5(seq, t, single, pair).sum())
    singles = len(seq) - 2 * pairs
    return np.array([singles, pairs, pairs + 1])


def train_g5(seqs: list[str], rounds: int = 10, start: tuple[float, float, float] = (0.4, 0.2, 0.4), canonical: float = 0.9) -> tuple[float, float, float]:
    """Rule probabilities of G5 by expectation maximisation over unfolded sequences; each round makes them no less likely."""
    single, pair = emissions(canonical)
    t = start
    for _ in range(rounds):
        n = sum((expected_rules(r, t, single, pair) for r in map(_letters, seqs) if r), np.zeros(3))
        if not n.sum():
            break
        t = tuple((n / n.sum()).tolist())
    return t
