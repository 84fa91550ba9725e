"""Substitution matrices, rates, pairwise Potts models and simulated alignments."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.operators.trees import GAP, encode

# ---- substitution matrices -------------------------------------------------------------------


def joint_substitutions(rows: DataFrame, min_id: float = 0.5) -> DataFrame:
    """(a, b, n): residues that meet in a column in pairs of rows alike by ``min_id`` or more, both orders, over all alignments.

    Alignments are groups; the counts add up. Over all sequence pairs at once by matrix products.
    """

    def f(t: pd.DataFrame) -> pd.DataFrame:
        x = encode(t.aseq.tolist())
        hot = [(x == k).astype(float) for k in range(4)]
        has = (x < GAP).sum(1)
        meet = [[hot[a] @ hot[b].T for b in range(4)] for a in range(4)]
        same = sum(meet[k][k] for k in range(4))
        use = np.triu(same / np.maximum(np.minimum(has[:, None], has[None, :]), 1) >= min_id, 1)
        return pd.DataFrame([(a, b, float(meet[a][b][use].sum() + meet[b][a][use].sum()) / 2) for a in range(4) for b in range(4)], columns=["a", "b", "n"])

    d = rows.where("aln_id IS NOT NULL AND aseq IS NOT NULL").select("aln_id", "aseq").groupBy("aln_id").applyInPandas(f, "a int, b int, n double")
    return d.groupBy("a", "b").agg(F.sum("n").alias("n"))


def conditionals(joint: np.ndarray) -> np.ndarray:
    """P(b | a) of a matrix of joint counts; a row without counts stays where it is."""
    j = np.asarray(joint, float)
    s = j.sum(1, keepdims=True)
    return np.where(s > 0, j / np.maximum(s, 1e-300), np.eye(len(j)))


def rates(cond: np.ndarray) -> np.ndarray:
    """Rate matrix whose exponential is ``cond``: the matrix logarithm, with negative rates set to 0 and rows summing to 0."""
    v, u = np.linalg.eig(cond)
    q = (u @ np.diag(np.log(np.maximum(v.real, 1e-12) + 0j)) @ np.linalg.inv(u)).real
    q = np.where(np.eye(len(q)) > 0, 0, np.maximum(q, 0))
    return q - np.diag(q.sum(1))


def at_time(q: np.ndarray, t: float) -> np.ndarray:
    """exp(t q) by scaling and squaring of a Taylor series."""
    a = q * t
    k = max(0, int(np.ceil(np.log2(max(np.abs(a).sum(1).max(), 1e-12)))) + 4)
    a = a / 2**k
    out = term = np.eye(len(q))
    for n in range(1, 16):
        term = term @ a / n
        out = out + term
    for _ in range(k):
        out = out @ out
    return out


def saturation_time(q: np.ndarray, tol: float = 1e-3) -> float:
    """Least doubling time at which all rows of exp(t q) agree to ``tol``."""
    t = 1.0
    while t < 1e9:
        p = at_time(q, t)
        if np.ptp(p, axis=0).max() < tol:
            return t
        t *= 2
    return np.inf


# ---- Potts models ----------------------------------------------------------------------------


def one_hot(x: np.ndarray) -> np.ndarray:
    """Rows as vectors of length width * 5, gaps included."""
    return (x[:, :, None] == np.arange(5)).reshape(len(x), -1).astype(float)


def fit_site(x: np.ndarray, site: int, mu: float = 0.01, steps: int = 100, rate: float = 0.5) -> np.ndarray:
    """Couplings [width*5, 5] and, last, the fields [5] of one column given the others: penalised multinomial regression (asymmetric pseudo-likelihood)."""
    n, width = x.shape
    z = one_hot(x)
    z[:, site * 5 : site * 5 + 5] = 0
    z = np.hstack([z, np.ones((n, 1))])
    y = (x[:, site, None] == np.arange(5)).astype(float)
    w, m = np.zeros((width * 5 + 1, 5)), np.zeros((width * 5 + 1, 5))
    lip = np.linalg.norm(z, 2) ** 2 / n / 2 + mu
    for k in range(steps):  # Nesterov's accelerated gradient
        p = np.exp((s := z @ m) - s.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = z.T @ (p - y) / n + mu * m
        g[-1] -= 0.99 * mu * m[-1]
        new = m - g / lip * min(1.0, 2 * rate)
        m = new + k / (k + 3) * (new - w)
        w = new
    return w


def zero_sum(e: np.ndarray) -> np.ndarray:
    """A coupling block in the gauge where rows and columns sum to 0."""
    return e - e.mean(0, keepdims=True) - e.mean(1, keepdims=True) + e.mean()


def potts_scores(rows: DataFrame, mu: float = 0.01) -> DataFrame:
    """(aln_id, i, j, ptf, pta): Frobenius norm and sum of the residue couplings of every column pair.

    Each column of an alignment is a regression of its own, and a task of its own; blocks of both directions are averaged after a join.
    """

    def f(k, t: pd.DataFrame) -> pd.DataFrame:
        x = encode(t.aseq.tolist())
        site = int(k[1])
        w = fit_site(x, site, mu)[:-1].reshape(x.shape[1], 5, 5)
        return pd.DataFrame([(k[0], min(site, j) + 1, max(site, j) + 1, (zero_sum(w[j]) if site > j else zero_sum(w[j]).T).ravel().tolist()) for j in range(x.shape[1]) if j != site], columns=["aln_id", "i", "j", "e"])

    d = rows.where("aln_id IS NOT NULL AND length(aseq) > 0")
    width = d.groupBy("aln_id").agg(F.max(F.length("aseq")).alias("w"))
    d = d.join(width, "aln_id").select("aln_id", F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("site"), F.rpad("aseq", F.col("w"), "-").alias("aseq"))
    e = d.groupBy("aln_id", "site").applyInPandas(f, "aln_id string, i int, j int, e array<double>")
    mean = e.groupBy("aln_id", "i", "j").agg(*(F.avg(F.col("e")[k]).alias(f"e{k}") for k in range(25)))
    res = F.array(*(f"e{5 * a + b}" for a in range(4) for b in range(4)))
    return mean.select("aln_id", "i", "j", F.sqrt(F.aggregate(res, F.lit(0.0), lambda s, v: s + v * v)).alias("ptf"), F.aggregate(res, F.lit(0.0), lambda s, v: s + v).alias("pta"))


def hamiltonian(x: np.ndarray, h: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Energy of each row: -(fields + couplings over i < j), h [L, 5], e [L, L, 5, 5]."""
    n, width = x.shape
    out = -h[np.arange(width), x].sum(1)
    for i in range(width):
        for j in range(i + 1, width):
            out -= e[i, j, x[:, i], x[:, j]]
    return out


def gibbs(h: np.ndarray, e: np.ndarray, n: int, sweeps: int, rng: np.random.Generator) -> np.ndarray:
    """n rows drawn from a Potts model, each its own chain; e is symmetric: e[i, j, a, b] = e[j, i, b, a]."""
    width = len(h)
    x = rng.integers(0, 5, (n, width))
    for _ in range(sweeps):
        for i in range(width):
            s = h[i] + sum(e[i, j][:, x[:, j]].T for j in range(width) if j != i)
            p = np.exp(s - s.max(1, keepdims=True)).cumsum(1)
            x[:, i] = (rng.random(n)[:, None] * p[:, -1:] > p).sum(1)
    return x


# ---- simulation ------------------------------------------------------------------------------


def transitions(q: np.ndarray) -> Callable[[float], np.ndarray]:
    """t -> cumulated rows of exp(t q)."""
    if not np.array_equal(q, q.T):
        return lambda t: at_time(q, t).cumsum(1)
    w, u = np.linalg.eigh(q)
    return lambda t: np.maximum((u * np.exp(w * t)) @ u.T, 0).cumsum(1)


def evolve(root: np.ndarray, q: np.ndarray, edges: list[tuple[int, int, float]], n: int, seed: int, pairs: list[tuple[int, int]] = (), q16: np.ndarray | None = None, indel: float = 0.0, part: int = 0, parts: int = 1) -> tuple[list[int], np.ndarray]:
    """Leaves (numbers, rows) of a tree evolved from a root: columns by q, paired columns (from 0) together by a 16-state matrix, deletions at rate ``indel``.

    Insertions would be columns of their own, gapped elsewhere; a deleted residue stays a gap below. Every node draws from a
    stream of its own, so the ``parts`` of the leaves together are what one call gives; only a path's rows are held beside the part's.
    """
    left, right = np.array(pairs, int).reshape(-1, 2).T
    alone = np.setdiff1d(np.arange(len(root)), [left, right])
    kids: dict[int, list[tuple[int, float]]] = {}
    for p, c, b in edges:
        kids.setdefault(p, []).append((c, b))
    order = [max(p for p, *_ in edges)]
    for u in order:
        order.extend(c for c, _ in kids.get(u, ()))
    leaves = dict.fromkeys(range(n), 1)
    for u in reversed(order):
        if u in kids:
            leaves[u] = sum(leaves[c] for c, _ in kids[u])
    low, high = n * part // parts, n * (part + 1) // parts
    p4_at, p16_at = transitions(q), transitions(q16) if len(left) and q16 is not None else None
    ids, rows, todo = [], [], [(order[0], root, 0)]
    while todo:
        u, above, at = todo.pop()
        if u not in kids:
            ids.append(u)
            rows.append(above)
            continue
        for c, b in kids[u]:
            first, at = at, at + leaves[c]
            if first >= high or at <= low:
                continue
            rng, row = np.random.Generator(np.random.Philox(key=np.array([seed, c], np.uint64))), above.copy()
            live = alone[row[alone] < GAP]
            p4 = p4_at(b)[row[live]]
            row[live] = (rng.random(len(live))[:, None] * p4[:, -1:] > p4).sum(1)
            if p16_at:
                both = (row[left] < GAP) & (row[right] < GAP)
                i, j = left[both], right[both]
                p16 = p16_at(b)[row[i] * 4 + row[j]]
                row[i], row[j] = np.divmod((rng.random(len(i))[:, None] * p16[:, -1:] > p16).sum(1), 4)
            if indel:
                row[rng.random(len(row)) < 1 - np.exp(-indel * b)] = GAP
            todo.append((c, row, first))
    return ids, np.array(rows)


def random_tree(n: int, mean: float, rng: np.random.Generator) -> list[tuple[int, int, float]]:
    """Random joining of n leaves with exponential branch lengths."""
    alive, edges, size = list(range(n)), [], np.arange(n, 1, -1)
    first, second, b = rng.integers(0, size), rng.integers(0, size - 1), rng.exponential(mean, (n - 1, 2)).tolist()
    second += second >= first
    for node, (i, j) in enumerate(zip(first.tolist(), second.tolist()), n):
        edges += [(node, alive[i], b[node - n][0]), (node, alive[j], b[node - n][1])]
        alive[i] = node
        alive[j] = alive[-1]
        alive.pop()
    return edges


def star_tree(n: int, length: float) -> list[tuple[int, int, float]]:
    return [(n, k, length) for k in range(n)]


def jukes_cantor(k: int = 4) -> np.ndarray:
    """All changes alike, one expected in unit time."""
    return np.full((k, k), 1 / (k - 1)) - np.eye(k) * (1 + 1 / (k - 1))


def simulate(specs: DataFrame, seed: int = 1, cells: int = 2_000_000) -> DataFrame:
    """(aln_id, seq_id, aseq) for (aln_id, nseq, alen, mean_branch): alignments on random trees, the outer half of the columns paired inwards.

    Paired columns evolve together between the Watson-Crick and wobble pairs. The same seed gives the same rows. An alignment of more
    than ``cells`` residues and gaps is spread by parts of its tree; their number doesn't change the rows.
    """

    def f(t: pd.DataFrame) -> pd.DataFrame:
        r = t.iloc[0]
        rng = np.random.default_rng([seed, *r.aln_id.encode()])
        n, width = int(r.nseq), int(r.alen)
        pairs = [(i, width - 1 - i) for i in range(width // 4)]
        ok = [a * 4 + b for a in range(4) for b in range(4) if a + b in (3, 5)]
        q16 = np.zeros((16, 16))
        q16[np.ix_(ok, ok)] = jukes_cantor(len(ok))
        root = rng.integers(0, 4, width).astype(np.uint8)
        for i, j in pairs:
            root[i], root[j] = divmod(int(rng.choice(ok)), 4)
        ids, x = [0], root[None]
        if n > 1:
            ids, x = evolve(root, jukes_cantor(), random_tree(n, r.mean_branch, rng), n, int(rng.integers(0, 1 << 63)), pairs, q16, 0.02, int(r.part), int(r.parts))
        return pd.DataFrame({"aln_id": r.aln_id, "seq_id": ids, "aseq": [row.tobytes().decode() for row in np.frombuffer(b"ACGU-", np.uint8)[x]]})

    spark = specs.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)  # few bytes, much work: not to be coalesced
    need = F.ceil(F.col("nseq").cast("double") * F.col("alen") / cells)
    d = specs.withColumn("parts", F.greatest(F.least(need, F.col("nseq")), F.lit(1)).cast("long")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    return d.repartition(tasks, "aln_id", "part").groupBy("aln_id", "part").applyInPandas(f, "aln_id string, seq_id long, aseq string")
