"""Trees of sequences: UPGMA, midpoint root, ancestral residues by parsimony, substitutions replayed as a null.

Every alignment is one group; all its replicates and columns are done in numpy at once. A tree joins at most ``REPS`` representatives by UPGMA, the other
rows hang beside their nearest one: time and memory grow with the rows, not their square.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GAP = 4
#: Rows that UPGMA joins at most; an alignment up to this size gets the exact tree.
REPS = 256


def encode(rows: list[str]) -> np.ndarray:
    """Residue codes A C G U = 0..3, everything else 4."""
    code = np.full(256, GAP, np.uint8)
    for k, letters in enumerate(("Aa", "Cc", "Gg", "UuTt")):
        for c in letters:
            code[ord(c)] = k
    width = max(map(len, rows), default=0)
    x = np.full((len(rows), width), GAP, np.uint8)
    for n, r in enumerate(rows):
        x[n, : len(r)] = code[np.frombuffer(r.encode("latin-1", "replace"), np.uint8)]
    return x


def distances(x: np.ndarray, y: np.ndarray | None = None) -> np.ndarray:
    """1 - identity over the columns where both rows have residues; 1 where there are none. Of the rows of x, or of x and y."""
    z = x if y is None else y
    both = (x < GAP).astype(np.float32) @ (z < GAP).astype(np.float32).T
    same = sum((x == k).astype(np.float32) @ (z == k).astype(np.float32).T for k in range(4))
    d = np.where(both > 0, 1 - same.astype(float) / np.maximum(both, 1), 1.0)
    if y is None:
        np.fill_diagonal(d, 0)
    return d


def infer(x: np.ndarray, reps: int = REPS) -> list[tuple[int, int, float]]:
    """Edges (parent, child, length) of a tree of all rows, leaves 0..n-1, the root last.

    Up to ``reps`` rows this is UPGMA on identity. Of more, ``reps`` at even distances in the order of the rows as strings, so that like rows are
    covered, are joined by UPGMA; every other row becomes a leaf beside the representative nearest to it, the first of equals.
    """
    n = len(x)
    if n <= reps:
        return upgma(distances(x))
    order = np.lexsort(x.T[::-1])
    chosen = np.sort(order[np.linspace(0, n - 1, reps).astype(int)])
    near = np.concatenate([distances(x[a : a + 4096], x[chosen]).argmin(1) for a in range(0, n, 4096)])
    near[chosen] = np.arange(reps)
    far = np.empty(n)
    for k in range(reps):
        m = np.flatnonzero(near == k)
        far[m] = distances(x[m], x[chosen[k] : chosen[k] + 1])[:, 0]
    kids = np.bincount(near, minlength=reps)
    top = upgma(distances(x[chosen]))
    hub, node = {}, n  # a representative with others beside it is a leaf below a node of its own
    for k in np.flatnonzero(kids > 1).tolist():
        hub[k], node = node, node + 1
    name = [hub.get(k, int(chosen[k])) for k in range(reps)] + list(range(node, node + reps - 1))
    edges = [(hub[k], int(i), float(far[i]) / 2) for k in hub for i in np.flatnonzero(near == k)]
    return edges + [(name[p], name[c], b) for p, c, b in top]


def upgma(d: np.ndarray) -> list[tuple[int, int, float]]:
    """(parent, child, branch length): leaves are 0..n-1, inner nodes follow, the last is the root. Ties join the first pair."""
    n = len(d)
    if n < 2:
        return []
    size = {k: 1 for k in range(n)}
    height = {k: 0.0 for k in range(n)}
    m = np.full((2 * n - 1, 2 * n - 1), np.inf)
    m[:n, :n] = d
    m[np.arange(n), np.arange(n)] = np.inf
    alive, edges = list(range(n)), []
    for node in range(n, 2 * n - 1):
        sub = m[np.ix_(alive, alive)]
        a, b = np.unravel_index(int(sub.argmin()), sub.shape)
        i, j = sorted((alive[a], alive[b]))
        h = m[i, j] / 2
        edges += [(node, i, h - height[i]), (node, j, h - height[j])]
        others = [k for k in alive if k not in (i, j)]
        m[node, others] = m[others, node] = (size[i] * m[i, others] + size[j] * m[j, others]) / (size[i] + size[j])
        size[node], height[node] = size[i] + size[j], h
        alive = [*others, node]
    return edges


def midpoint_root(edges: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """The tree hung from the middle of its longest path between leaves; the new root is one above the largest node."""
    near: dict[int, dict[int, float]] = {}
    for p, c, b in edges:
        near.setdefault(p, {})[c] = b
        near.setdefault(c, {})[p] = b
    for p in [k for k, v in near.items() if len(v) == 2 and k == edges[-1][0]]:  # an old root of two branches dissolves
        (a, x), (b, y) = near.pop(p).items()
        del near[a][p], near[b][p]
        near[a][b] = near[b][a] = x + y

    def far(s):
        dist, back, todo = {s: 0.0}, {}, [s]
        for u in todo:
            for v, b in near[u].items():
                if v not in dist:
                    dist[v], back[v] = dist[u] + b, u
                    todo.append(v)
        end = max((v for v in dist if len(near[v]) == 1), key=lambda v: (dist[v], -v))
        return end, dist, back

    leaf = min(v for v in near if len(near[v]) == 1)
    a, *_ = far(leaf)
    b, dist, back = far(a)
    half, v = dist[b] / 2, b
    while dist[back[v]] > half:
        v = back[v]
    u, root = back[v], max(near) + 1
    del near[u][v], near[v][u]
    out, todo = [(root, u, half - dist[u]), (root, v, dist[v] - half)], [(u, root), (v, root)]
    for node, parent in todo:
        for c, w in near[node].items():
            if c != parent:
                out.append((node, c, w))
                todo.append((c, node))
    return out


def fitch(x: np.ndarray, edges: list[tuple[int, int, float]]) -> tuple[np.ndarray, np.ndarray]:
    """(states, changes): residues of all nodes by parsimony, all columns at once, and each column's least number of changes.

    States are sets in five bits, the gap one of them. Up: the intersection, else the union and one change; where gap and residues
    conflict only the residues stay. Down: the parent's state if allowed, else the lowest of the set. The root takes its lowest.
    """
    n, width = x.shape
    kids: dict[int, list[int]] = {}
    for p, c, _ in edges:
        kids.setdefault(p, []).append(c)
    nodes = max([n - 1, *kids]) + 1
    sets, changes = np.zeros((nodes, width), np.uint8), np.zeros(width, np.int64)
    sets[:n] = 1 << x
    roots = set(kids) - {c for v in kids.values() for c in v}
    order, todo = [], list(roots)
    for u in todo:
        order.append(u)
        todo += [c for c in kids.get(u, ()) if c in kids]
    for u in reversed(order):
        s = sets[kids[u][0]]
        for c in kids[u][1:]:
            both, either = s & sets[c], s | sets[c]
            miss = both == 0
            changes += miss
            s = np.where(miss, np.where((either & 15) > 0, either & 15, either), both)
        sets[u] = s
    lowest = np.array([0, *(int(k & -k).bit_length() - 1 for k in range(1, 32))], np.uint8)
    states = np.zeros((nodes, width), np.uint8)
    states[:n] = x
    for u in order:
        if u in roots:
            states[u] = lowest[sets[u]]
        for c in kids[u]:
            if c in kids:
                keep = (sets[c] >> states[u]) & 1
                states[c] = np.where(keep == 1, states[u], lowest[sets[c]])
    return states, changes


def replays(states: np.ndarray, edges: list[tuple[int, int, float]], n: int, reps: int, rng: np.random.Generator) -> np.ndarray:
    """Leaves of null alignments [reps, n, columns]: the root's columns are shuffled, and each branch's substitutions old -> new hit random places that hold old.

    Composition and number of changes on every branch are those of the real tree; columns become independent. So at every node all
    replicates hold each symbol equally often, and a branch is done for all of them by one sort.
    """
    kids: dict[int, list[int]] = {}
    for p, c, _ in edges:
        kids.setdefault(p, []).append(c)
    root = next(iter(set(kids) - {c for v in kids.values() for c in v}))
    width = states.shape[1]
    out, low, first_of = np.empty((reps, n, width), np.uint8), np.uint64((1 << width.bit_length()) - 1), np.arange(reps)[:, None] * width
    todo = [(root, states[root][rng.random((reps, width)).argsort(1)])]
    while todo:  # only nodes whose children are to come are held
        u, above = todo.pop()
        for c in kids[u]:
            row, hit = above, np.flatnonzero(states[u] != states[c])
            if len(hit):
                old, new = states[u][hit], states[c][hit]
                # places by what they hold, at random among the same: a place stands in the lowest bits of the number that it is sorted by
                order = (above + rng.random((reps, width))).view(np.uint64)
                order = ((order & ~low) | np.arange(width, dtype=np.uint64))
                order.sort(1)
                first = np.concatenate([[0], np.cumsum(np.bincount(states[u], minlength=GAP + 1))])
                by = np.argsort(old, kind="stable")
                old = old[by]
                slot = first[old] + np.arange(len(old)) - np.searchsorted(old, old)
                row = above.copy()
                row.ravel()[(order[:, slot] & low).astype(np.int64) + first_of] = new[by]
            if c in kids:
                todo.append((c, row))
            else:
                out[:, c] = row
    return out


def replay(states: np.ndarray, edges: list[tuple[int, int, float]], n: int, rng: np.random.Generator) -> np.ndarray:
    return replays(states, edges, n, 1, rng)[0]


def build(rows: DataFrame) -> DataFrame:
    """(aln_id, parent, child, is_leaf, blen) by ``infer`` on identity, for (aln_id, seq_id, aseq); leaves are numbered by seq_id from 0.

    A task holds one alignment's rows and their distances to ``REPS`` of them.
    """

    def f(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("seq_id")
        e = infer(encode(t.aseq.tolist()))
        return pd.DataFrame([(t.aln_id.iloc[0], p, c, c < len(t), b) for p, c, b in e], columns=["aln_id", "parent", "child", "is_leaf", "blen"])

    return rows.where("aln_id IS NOT NULL AND aseq IS NOT NULL").select("aln_id", "seq_id", "aseq").groupBy("aln_id").applyInPandas(f, "aln_id string, parent int, child int, is_leaf boolean, blen double")


def ancestors(rows: DataFrame) -> DataFrame:
    """(aln_id, node, parent, blen, seq_id, aseq): every node of an alignment's tree with its residues by parsimony; leaves carry their seq_id, the root no parent."""

    def f(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("seq_id", ignore_index=True)
        x = encode(t.aseq.tolist())
        e = infer(x)
        states = fitch(x, e)[0] if e else x
        up = {c: (p, b) for p, c, b in e}
        text = np.frombuffer(b"ACGU-", np.uint8)[states]
        rows = [(t.aln_id[0], k, up[k][0] if k in up else None, up[k][1] if k in up else None, int(t.seq_id[k]) if k < len(t) else None, text[k].tobytes().decode()) for k in range(len(states))]
        return pd.DataFrame(rows, columns=["aln_id", "node", "parent", "blen", "seq_id", "aseq"]).astype({"parent": "Int32", "seq_id": "Int64"})

    return rows.where("aln_id IS NOT NULL AND aseq IS NOT NULL").select("aln_id", "seq_id", "aseq").groupBy("aln_id").applyInPandas(f, "aln_id string, node int, parent int, blen double, seq_id long, aseq string")


def branch_changes(x: np.ndarray, edges: list[tuple[int, int, float]], states: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(change, there) of every branch and column: whether its ends differ, and whether both hold residues. states: those of ``fitch``, if known."""
    states = fitch(x, edges)[0] if states is None else states
    p, c = states[[e[0] for e in edges]], states[[e[1] for e in edges]]
    there = (p < GAP) & (c < GAP)
    return (p != c) & there, there


def pair_changes(x: np.ndarray, edges: list[tuple[int, int, float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(single, double, join): substitutions of each column; branches on which both columns of a pair change, and on which either does, all four ends residues."""
    if not edges:
        w = x.shape[1]
        return np.zeros(w, np.int64), np.zeros((w, w), np.int64), np.zeros((w, w), np.int64)
    ch, there = (m.astype(np.float32) for m in branch_changes(x, edges))
    still = there - ch
    both = ch.T @ ch
    return ch.sum(0).astype(np.int64), both.astype(np.int64), np.rint(there.T @ there - still.T @ still).astype(np.int64)


def column_subs(rows: DataFrame) -> DataFrame:
    """(aln_id, col, nsubs): substitutions of each column over the branches of the alignment's tree, both ends residues."""

    def f(t: pd.DataFrame) -> pd.DataFrame:
        x = encode(t.sort_values("seq_id").aseq.tolist())
        e = infer(x)
        n = branch_changes(x, e)[0].sum(0) if e else np.zeros(x.shape[1], np.int64)
        return pd.DataFrame({"aln_id": t.aln_id.iloc[0], "col": np.arange(1, x.shape[1] + 1), "nsubs": n})

    return rows.where("aln_id IS NOT NULL AND aseq IS NOT NULL").select("aln_id", "seq_id", "aseq").groupBy("aln_id").applyInPandas(f, "aln_id string, col int, nsubs long")


def clades(edges: DataFrame) -> DataFrame:
    """(aln_id, node, leaf, dist): the leaves below every inner node and how far they are, from (aln_id, parent, child, is_leaf, blen).

    Children are followed one level a round, and only what has grown goes on.
    """
    from strandlake.storage import materialize

    edges = materialize(edges, "edges")
    step = edges.select("aln_id", F.col("parent").alias("node"), F.col("child").alias("at"), F.col("blen").alias("dist"), "is_leaf")
    done = []
    for _ in range(10_000):
        step = materialize(step, "clades")
        done.append(step.where("is_leaf").select("aln_id", "node", F.col("at").alias("leaf"), "dist"))
        inner = step.where("NOT is_leaf")
        if inner.isEmpty():
            break
        step = inner.drop("is_leaf").join(edges.select("aln_id", F.col("parent").alias("at"), "child", "blen", "is_leaf"), ["aln_id", "at"]).select("aln_id", "node", F.col("child").alias("at"), (F.col("dist") + F.col("blen")).alias("dist"), "is_leaf")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def lowest_common(clade: DataFrame, pairs: DataFrame) -> DataFrame:
    """(aln_id, a, b, node): the smallest clade that holds both leaves of each pair (aln_id, a, b), the least number of equals."""
    size = clade.groupBy("aln_id", "node").agg(F.count(F.lit(1)).alias("n"))
    a = pairs.join(clade.select("aln_id", F.col("leaf").alias("a"), "node"), ["aln_id", "a"])
    both = a.join(clade.select("aln_id", F.col("leaf").alias("b"), "node"), ["aln_id", "b", "node"]).join(size, ["aln_id", "node"])
    return both.groupBy("aln_id", "a", "b").agg(F.min(F.struct("n", "node"))["node"].alias("node"))


def node_times(clade: DataFrame) -> DataFrame:
    """(aln_id, node, n_leaves, height): the farthest leaf below every inner node."""
    return clade.groupBy("aln_id", "node").agg(F.count(F.lit(1)).alias("n_leaves"), F.max("dist").alias("height"))


def scale_branches(edges: DataFrame, mode: str = "average", to: float = 1.0) -> DataFrame:
    """edges with other lengths: multiplied so that their mean is ``to``, all equal to it, or multiplied by it."""
    if mode == "equal":
        return edges.withColumn("blen", F.lit(float(to)))
    if mode == "rescale":
        return edges.withColumn("blen", F.col("blen") * to)
    mean = edges.groupBy("aln_id").agg(F.avg("blen").alias("_m"))
    return edges.join(mean, "aln_id").withColumn("blen", F.when(F.col("_m") > 0, F.col("blen") * to / F.col("_m")).otherwise(F.col("blen"))).drop("_m")


def column_changes(rows: DataFrame) -> DataFrame:
    """(aln_id, col, changes): least substitutions of each column on the UPGMA tree."""

    def f(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("seq_id")
        x = encode(t.aseq.tolist())
        _, ch = fitch(x, infer(x))
        return pd.DataFrame({"aln_id": t.aln_id.iloc[0], "col": np.arange(1, x.shape[1] + 1), "changes": ch})

    return rows.where("aln_id IS NOT NULL AND aseq IS NOT NULL").select("aln_id", "seq_id", "aseq").groupBy("aln_id").applyInPandas(f, "aln_id string, col int, changes long")


def null_rows(rows: DataFrame, reps: int = 1, seed: int = 1) -> DataFrame:
    """(aln_id, rep, seq_id, aseq): alignments with the tree's substitutions replayed; replicates are groups of their own."""

    def f(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("seq_id", ignore_index=True)
        x = encode(t.aseq.tolist())
        e = infer(x)
        if not e:
            return t[["aln_id", "rep", "seq_id", "aseq"]]
        states, _ = fitch(x, e)
        got = replay(states, e, len(x), np.random.default_rng([seed, int(t.rep[0]), *t.aln_id[0].encode()]))
        return t.assign(aseq=["".join("ACGU-"[v] for v in r) for r in got])[["aln_id", "rep", "seq_id", "aseq"]]

    d = rows.where("aln_id IS NOT NULL AND aseq IS NOT NULL").select("aln_id", F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("rep"), "seq_id", "aseq")
    return d.groupBy("aln_id", "rep").applyInPandas(f, "aln_id string, rep int, seq_id long, aseq string")


def clusters(ident: DataFrame, seqs: DataFrame, threshold: float) -> DataFrame:
    """(aln_id, seq, cluster): single linkage at identity >= threshold, by the least sequence reached; labels spread by joins.

    Each round takes the least label of neighbours and then the label's own label, so chains shrink fast.
    """
    from strandlake.storage import materialize, release

    near = ident.where(F.col("ident") >= threshold)
    edges = materialize(near.select("aln_id", F.col("a").alias("u"), F.col("b").alias("v")).unionByName(near.select("aln_id", F.col("b").alias("u"), F.col("a").alias("v"))), "edges")
    former = lab = materialize(seqs.select("aln_id", "seq", F.col("seq").alias("cluster")), "labels")
    for _ in range(64):
        least = edges.join(lab.select("aln_id", F.col("seq").alias("v"), F.col("cluster").alias("c")), ["aln_id", "v"]).groupBy("aln_id", F.col("u").alias("seq")).agg(F.min("c").alias("c"))
        step = lab.join(least, ["aln_id", "seq"], "left").select("aln_id", "seq", "cluster", F.least("cluster", F.coalesce("c", "cluster")).alias("n"))
        jump = step.join(lab.select("aln_id", F.col("seq").alias("n"), F.col("cluster").alias("m")), ["aln_id", "n"]).select("aln_id", "seq", F.least("n", "m").alias("cluster"), (F.least("n", "m") < F.col("cluster")).alias("moved"))
        nxt = materialize(jump, "labels")
        release(former)
        former, lab = nxt, nxt.drop("moved")
        if nxt.where("moved").isEmpty():
            return lab
    raise RuntimeError("labels did not settle")


def min_identity(ident: DataFrame, seqs: DataFrame, threshold: float) -> DataFrame:
    """(aln_id, seq): the largest single-linkage cluster of each alignment, the least label of equal ones."""
    c = clusters(ident, seqs, threshold)
    size = c.groupBy("aln_id", "cluster").agg(F.count(F.lit(1)).alias("n"))
    best = size.groupBy("aln_id").agg(F.max_by("cluster", F.struct("n", -F.col("cluster"))).alias("cluster"))
    return c.join(best, ["aln_id", "cluster"]).select("aln_id", "seq")


def max_identity(rows: DataFrame, maxid: float) -> DataFrame:
    """(aln_id, seq_id): rows kept in order, one dropped if as alike as ``maxid`` to a kept one. Sequential within an alignment."""

    def f(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("seq_id", ignore_index=True)
        x = encode(t.aseq.tolist())
        n = (x < GAP).sum(1)
        kept: list[int] = []
        for k in range(len(t)):
            if kept:
                same = ((x[kept] == x[k]) & (x[k] < GAP)).sum(1)
                if (same / np.maximum(np.minimum(n[kept], n[k]), 1) >= maxid).any():
                    continue
            kept.append(k)
        return t.loc[kept, ["aln_id", "seq_id"]]

    return rows.where("aln_id IS NOT NULL AND aseq IS NOT NULL").select("aln_id", "seq_id", "aseq").groupBy("aln_id").applyInPandas(f, "aln_id string, seq_id long")
