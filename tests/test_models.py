import itertools

import numpy as np

from strandlake.operators import models as M
from strandlake.operators import trees as T


def test_upgma_and_midpoint():
    d = np.array([[0, 2, 6, 6], [2, 0, 6, 6], [6, 6, 0, 4], [6, 6, 4, 0]], float)
    e = T.upgma(d)
    assert {(c, b) for _, c, b in e} == {(0, 1.0), (1, 1.0), (2, 2.0), (3, 2.0), (4, 2.0), (5, 1.0)}
    # hang the same tree elsewhere: distances between leaves stay, and the root is as far from both ends of the longest path
    def path(edges):
        up = {c: (p, b) for p, c, b in edges}
        out = {}
        for a, b in itertools.combinations(range(4), 2):
            def line(v):
                r = {v: 0.0}
                while v in up:
                    p, w = up[v]
                    r[p] = r[v] + w
                    v = p
                return r
            x, y = line(a), line(b)
            out[a, b] = min(x[v] + y[v] for v in x if v in y)
        return out
    lop = [(4, 0, 0.5), (4, 1, 3.0), (5, 4, 0.25), (5, 2, 1.0), (6, 5, 5.0), (6, 3, 1.0)]
    m = T.midpoint_root(lop)
    assert {k: round(v, 9) for k, v in path(m).items()} == {k: round(v, 9) for k, v in path(lop).items()}
    assert T.upgma(np.zeros((1, 1))) == []


def test_fitch_counts_against_all_labellings():
    rng = np.random.default_rng(1)
    e = [(4, 0, 1), (4, 1, 1), (5, 2, 1), (5, 3, 1), (6, 4, 1), (6, 5, 1)]
    x = rng.integers(0, 4, (4, 30)).astype(np.uint8)
    states, ch = T.fitch(x, e)
    for col in range(30):
        best = min(sum((list(x[:, col]) + list(s))[p] != (list(x[:, col]) + list(s))[c] for p, c, _ in e) for s in itertools.product(range(4), repeat=3))
        assert ch[col] == best == sum(states[p, col] != states[c, col] for p, c, _ in e)


def test_replayed_null_keeps_every_branch(spark):
    rng = np.random.default_rng(2)
    e = T.upgma(T.distances(x := rng.integers(0, 4, (6, 40)).astype(np.uint8)))
    states, _ = T.fitch(x, e)
    y = T.replay(states, e, 6, np.random.default_rng(3))
    assert y.shape == x.shape and sorted(np.bincount(y.ravel(), minlength=4)) != []
    rows = spark.createDataFrame([("a", k, "".join("ACGU"[v] for v in r)) for k, r in enumerate(x)] + [("b", 9, "ACG"), ("c", 1, None)], "aln_id string, seq_id long, aseq string")
    got = T.null_rows(rows, 2).collect()
    assert len(got) == 14 and T.build(rows).count() == 10 and T.column_changes(rows).where("aln_id = 'a'").count() == 40
    assert [r.aseq for r in sorted(T.null_rows(rows, 2).collect())] == [r.aseq for r in sorted(got)]


def test_identity_filters(spark):
    rows = spark.createDataFrame([("a", 1, "ACGUACGU"), ("a", 2, "ACGUACGA"), ("a", 3, "UUUUUUUU"), ("a", 4, "ACGUACGU")], "aln_id string, seq_id long, aseq string")
    assert sorted(r.seq_id for r in T.max_identity(rows, 0.85).collect()) == [1, 3]
    ident = spark.createDataFrame([("a", k, k + 1, 0.9) for k in range(1, 40)] + [("a", 50, 51, 0.95), ("a", 1, 50, 0.2)], "aln_id string, a long, b long, ident double")
    seqs = spark.createDataFrame([("a", k) for k in [*range(1, 41), 50, 51, 60]], "aln_id string, seq long")
    got = {r.seq: r.cluster for r in T.clusters(ident, seqs, 0.8).collect()}
    assert {got[k] for k in range(1, 41)} == {1} and got[50] == got[51] == 50 and got[60] == 60
    assert sorted(r.seq for r in T.min_identity(ident, seqs, 0.8).collect()) == list(range(1, 41))


def test_rates_and_times():
    q = M.jukes_cantor()
    p = M.at_time(q, 0.3)
    same = 0.25 + 0.75 * np.exp(-4 / 3 * 0.3)
    assert np.allclose(np.diag(p), same) and np.allclose(p.sum(1), 1)
    assert np.allclose(M.rates(p), q * 0.3, atol=1e-8) and M.saturation_time(q) <= 16
    assert np.allclose(M.conditionals([[2, 2], [0, 0]]), [[0.5, 0.5], [0, 1]])


def test_joint_substitutions(spark):
    rows = spark.createDataFrame([("a", "ACGU"), ("a", "ACGA"), ("a", "----"), ("b", "GG")], "aln_id string, aseq string")
    got = {(r.a, r.b): r.n for r in M.joint_substitutions(rows).collect() if r.n}
    assert got == {(0, 0): 1, (1, 1): 1, (2, 2): 1, (0, 3): 0.5, (3, 0): 0.5}


def test_potts_finds_the_coupled_pair(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 4, (150, 5))
    x[:, 4] = 3 - x[:, 0]
    rows = spark.createDataFrame([("a", "".join("ACGU"[v] for v in r)) for r in x], "aln_id string, aseq string")
    best = max(M.potts_scores(rows).collect(), key=lambda r: r.ptf)
    assert (best.i, best.j) == (1, 5)
    e = np.zeros((2, 2, 5, 5))
    e[0, 1] = e[1, 0] = np.eye(5) * 4
    y = M.gibbs(np.zeros((2, 5)), e, 400, 20, rng)
    assert (y[:, 0] == y[:, 1]).mean() > 0.8
    assert M.hamiltonian(np.array([[1, 1], [1, 2]]), np.zeros((2, 5)), e).tolist() == [-4, 0]
    assert np.allclose(M.zero_sum(rng.random((5, 5))).sum(0), 0)


def test_simulated_pairs_covary(spark):
    d = M.simulate(spark.createDataFrame([("a", 60, 16, 0.3), ("b", 1, 8, 0.1)], "aln_id string, nseq int, alen int, mean_branch double"))
    rows = {r.seq_id: r.aseq for r in d.where("aln_id = 'a'").collect()}
    assert len(rows) == 60 and all(len(v) == 16 for v in rows.values()) and d.where("aln_id = 'b'").count() == 1
    ok = {"AU", "UA", "GC", "CG", "GU", "UG"}
    both = [v[0] + v[15] for v in rows.values() if "-" not in v[0] + v[15]]
    assert all(p in ok for p in both)


def test_simulated_sizes_are_the_declared_ones(spark, tmp_path):
    from strandlake.plans.reports import simulated

    spark.createDataFrame([("a", 150, 300), ("b", None, 7), ("c", 61, 121)], "aln_id string, nseq int, alen int").write.parquet(str(tmp_path / "alignments.parquet"))
    rows = simulated(spark, str(tmp_path)).collect()
    for k, n, width in (("a", 150, 300), ("b", 1, 7), ("c", 61, 121)):
        own = [r for r in rows if r.aln_id == k]
        assert sorted(r.seq_id for r in own) == list(range(n)) and {len(r.aseq) for r in own} == {width}


def test_parts_of_a_simulation_are_the_whole(spark):
    d = spark.createDataFrame([("a", 41, 20, 0.3), ("b", 3, 200, 0.1)], "aln_id string, nseq int, alen int, mean_branch double")
    whole = sorted(M.simulate(d).collect())
    assert sorted(M.simulate(d, cells=100).collect()) == whole and len(whole) == 44 and len({r.aseq for r in whole}) > 20
