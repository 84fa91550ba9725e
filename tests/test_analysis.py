import itertools
import math
import random
import time

import numpy as np
import pytest

from strandlake.operators import analysis as A
from strandlake.operators import contacts as C
from strandlake.operators import filters as X
from strandlake.operators import pairs as P
from strandlake.operators import reports as R
from strandlake.operators import significance as S
from strandlake.operators import structure as T
from strandlake.operators import trees


def helix_rows(rng, n, width, pairs):
    x = rng.integers(0, 4, (n, width)).astype(np.uint8)
    for i, j in pairs:
        x[:, j] = 3 - x[:, i]
    x[rng.random(x.shape) < 0.03] = 4
    return x


def text(x):
    return ["".join("ACGU-"[v] for v in r) for r in x]


@pytest.mark.parametrize("pooled", [False, True])
def test_scores_are_those_of_the_pair_statistics(spark, pooled):
    rng = np.random.default_rng(1)
    x = helix_rows(rng, 30, 9, [(0, 8)])
    cells = [("a", s, c + 1, int(v)) for s, r in enumerate(x) for c, v in enumerate(r)]
    pp = P.joint(P.joint_counts(spark.createDataFrame(cells, "aln_id string, seq long, col int, res int")))
    d = P.with_marginals(pp).select("aln_id", "i", "j", P.covariation("gt", "C2" if pooled else "C16").alias("g"))
    want = {(r.i, r.j): (r.g, r.g_apc) for r in P.correct(d, "g").collect()}
    for dtype, tol in ((np.float64, 1e-5), (np.float32, 2e-2)):
        s, nseff, _ = A.g_test(x, np.ones(30), pooled, dtype)
        c = A.product_corrected(s.astype(float))
        for (i, j), (g, apc) in want.items():
            assert s[i - 1, j - 1] == pytest.approx(g, abs=tol) and c[i - 1, j - 1] == pytest.approx(apc, abs=tol)


def test_null_has_the_rules_of_the_tables(spark):
    rng = np.random.default_rng(2)
    null, real = rng.gamma(2, 3, 800), np.concatenate([rng.gamma(2, 3, 50), [-5.0, 40.0, 400.0, 1e4]])
    n = A.Null([null])
    schema = "aln_id string, i int, j int, score double"
    nd = spark.createDataFrame([("a", 0, k, float(v)) for k, v in enumerate(null)], schema)
    rd = spark.createDataFrame([("a", 0, k, float(v)) for k, v in enumerate(real)], schema)
    frame = S.bin_frame(nd)
    hist = S.histogram(nd, frame)
    got = {r.j: r.pval for r in S.p_values(rd, hist, S.fit_exponential(hist, S.tail(hist), frame), frame).collect()}
    for k, p in enumerate(n.p_value(real)):
        assert got[k] == pytest.approx(p, rel=1e-9)
    assert min(got.values()) > 0 and got[len(real) - 4] == pytest.approx(1.0)


def test_constant_null_gives_one_over_its_count(spark):
    schema = "aln_id string, i int, j int, score double"
    null = spark.createDataFrame([("a", 0, k, 1.0) for k in range(10)], schema)
    frame = S.bin_frame(null)
    hist = S.histogram(null, frame)
    p = S.p_values(spark.createDataFrame([("a", 1, 2, 50.0), ("a", 1, 3, 1.0)], schema), hist, S.fit_exponential(hist, S.tail(hist), frame), frame)
    assert {r.j: r.pval for r in p.collect()} == {2: 0.1, 3: 0.1}
    assert A.Null([np.ones(10)]).p_value(np.array([50.0, 1.0])).tolist() == [0.1, 0.1]


def test_null_takes_one_replicate_at_a_time():
    """A null's scores are counted as they come, so that a wide alignment's never lie in memory together."""
    rng = np.random.default_rng(8)
    parts = [rng.gamma(2, 3 + k, 500) for k in (0, 4, 1)]
    one, whole = A.Null(iter(parts)), A.Null([parts[0], np.concatenate(parts[1:])])
    assert one.nc == 1500 and (one.obs == whole.obs).all() and (one.p_value(parts[1]) == whole.p_value(parts[1])).all()


def test_scores_over_several_blocks_of_columns_in_used_arrays():
    rng = np.random.default_rng(9)
    scratch = A.Scratch()
    for width in (300, 700, 40):  # a block's columns are 256
        x, w = helix_rows(rng, 12, width, [(3, width - 5)]), rng.random(12) + 0.5
        got, nseff, canonical = A.g_test(x, w, False, np.float64, scratch)
        for i, j in [(3, width - 5), (0, 1), (width - 2, 7), (30, 31), *rng.integers(0, width, (60, 2))]:
            if i != j:
                both = (x[:, i] < 4) & (x[:, j] < 4)
                c = np.array([[w[(x[:, i] == a) & (x[:, j] == b)].sum() for b in range(4)] for a in range(4)])
                assert nseff[i, j] == pytest.approx(w[both].sum()) and canonical[i, j] == pytest.approx(sum(c[a, b] for a in range(4) for b in range(4) if a + b in (3, 5)) / c.sum())
        again = A.g_test(x, w, False)[0]
        up = np.triu_indices(width, 1)
        assert np.allclose(got[up], again[up], atol=1e-9) and np.allclose(got[up], got.T[up], atol=1e-9)
        want = A.product_corrected(again)
        assert np.allclose(A.product_corrected(got, scratch)[up], want[up], atol=1e-9)


@pytest.mark.parametrize("rows, width", [(12, 300), (150, 140), (6, 300), (3, 1100)])
def test_null_scores_are_single_and_leave_shares_out(rows, width):
    """In strips of columns, few rows or many, on 16 cells or pooled: the scores of the doubles, without what only the real alignment needs."""
    rng = np.random.default_rng(10)
    x, w = helix_rows(rng, rows, width, [(3, width - 5)]), rng.random(rows) + 0.5
    x[:, 7] = x[:, 9] = 4
    x[0, 9] = 2  # columns 7 and 9 meet in no row
    pooled = rows <= 8
    want, nseff, canonical = A.g_test(x, w, pooled)
    got, _, none = A.g_test(x, w, pooled, np.float32, A.Scratch(), False)
    assert got.dtype == np.float32 and none is None and np.isfinite(got).all()
    up = np.triu_indices(width, 1)
    assert np.allclose(got[up], want[up], atol=2e-2) and np.allclose(got[up], got.T[up], atol=1e-3)
    assert nseff[7, 9] == canonical[7, 9] == 0 and want[7, 9] == pytest.approx(0, abs=1e-9)
    for i, j in [(3, width - 5), (0, 1), (width - 2, 40), *rng.integers(10, width, (40, 2))]:
        if i != j:
            c = np.array([[w[(x[:, i] == a) & (x[:, j] == b)].sum() for b in range(4)] for a in range(4)])
            assert nseff[i, j] == pytest.approx(c.sum()) and canonical[i, j] == pytest.approx(sum(c[a, b] for a in range(4) for b in range(4) if a + b in (3, 5)) / max(c.sum(), 1e-30), abs=1e-12)


def test_large_trees_hold_every_row_once():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 4, (6, 50)).astype(np.uint8)
    x = base[rng.integers(0, 6, 90)].copy()
    x[rng.random(x.shape) < 0.1] = 2
    for reps in (90, 20, 7):
        e = trees.infer(x, reps)
        kids, parents = [c for _, c, _ in e], [p for p, _, _ in e]
        assert len(kids) == len(set(kids)) and set(range(90)) <= set(kids) and not set(range(90)) & set(parents)
        roots = set(parents) - set(kids)
        assert len(roots) == 1 and set(kids) | roots == set(range(len(e) + 1))
        states, _ = trees.fitch(x, e)
        assert (states[:90] == x).all()
    assert trees.infer(x, 90) == trees.upgma(trees.distances(x))


def test_pair_changes_against_brute_force():
    rng = np.random.default_rng(4)
    x = helix_rows(rng, 12, 7, [(1, 5)])
    e = trees.infer(x)
    states, _ = trees.fitch(x, e)
    one, two, either = trees.pair_changes(x, e)
    ch = lambda p, c, k: states[p, k] < 4 and states[c, k] < 4 and states[p, k] != states[c, k]
    ok = lambda p, c, k: states[p, k] < 4 and states[c, k] < 4
    for i in range(7):
        assert one[i] == sum(ch(p, c, i) for p, c, _ in e)
        for j in range(i + 1, 7):
            assert two[i, j] == sum(ch(p, c, i) and ch(p, c, j) for p, c, _ in e)
            assert either[i, j] == sum(ok(p, c, i) and ok(p, c, j) and (ch(p, c, i) or ch(p, c, j)) for p, c, _ in e)


def test_replays_keep_composition_and_changes():
    rng = np.random.default_rng(5)
    x = helix_rows(rng, 10, 40, [])
    e = trees.infer(x)
    states, _ = trees.fitch(x, e)
    got = trees.replays(states, e, 10, 6, np.random.default_rng(1))
    assert got.shape == (6, 10, 40) and len({g.tobytes() for g in got}) == 6
    for g in got:
        assert all((np.bincount(g[k], minlength=5) == np.bincount(x[k], minlength=5)).all() for k in range(10))


def test_covarying_finds_the_helix(spark):
    rng = np.random.default_rng(6)
    pairs = [(0, 29), (1, 28), (2, 27)]
    x = helix_rows(rng, 40, 60, pairs)
    ss = ["." for _ in range(60)]
    for i, j in [*pairs, (10, 20)]:
        ss[i], ss[j] = "<", ">"
    rows = [("a", k, t) for k, t in enumerate(text(x))] + [("one", 900, "ACGU"), ("none", 901, None), (None, 902, "ACGU")]
    d = spark.createDataFrame(rows, "aln_id string, seq_id long, aseq string")
    s = spark.createDataFrame([("a", "".join(ss)), ("one", "<..>")], "aln_id string, ss string")
    got = {(r.i, r.j): r for r in A.covarying(d, s, [(0, 0.0), (5, 0.5)], nulls=4).collect()}
    assert {(i + 1, j + 1) for i, j in pairs} <= {k for k, r in got.items() if r.evalue < 0.05}
    assert got[11, 21].is_bp and got[11, 21].evalue > 0.05 and all(r.pval > 0 for r in got.values())
    assert {r.power for r in got.values()} == {0.5} and {r.aln_id for r in got.values()} == {"a"}
    again = {(r.i, r.j): r for r in A.covarying(d, s, [(0, 0.0), (5, 0.5)], nulls=4).collect()}
    assert again == got


def test_base_pairs_alone_need_no_nulls_without_any(monkeypatch):
    rng = np.random.default_rng(7)
    rows, ss = text(helix_rows(rng, 30, 60, [(0, 29), (1, 28)])), "<<" + "." * 26 + ">>" + "." * 30
    whole, alone = A.analyse(rows, ss, 3, 4), A.analyse(rows, ss, 3, 4, bp_only=True)
    assert len(alone["i"]) == 2 and all((alone[k] == whole[k][whole["is_bp"]]).all() for k in whole)

    def drawn(*_):
        raise AssertionError("a null was drawn")

    monkeypatch.setattr(trees, "replays", drawn)
    gone = ["-" + r[1:] for r in rows]  # the only pair's column has gaps alone
    assert A.analyse(rows, None, 3, 4, bp_only=True) is None and A.analyse(gone, "<" + "." * 28 + ">", 3, 4, bp_only=True) is None


def test_base_pairs_alone_are_all_that_is_weighed(monkeypatch):
    rng = np.random.default_rng(11)
    rows, ss = text(helix_rows(rng, 30, 60, [(0, 29), (1, 28)])), "<<" + "." * 26 + ">>" + "." * 30
    weighed, real = [], A.Null.p_value
    monkeypatch.setattr(A.Null, "p_value", lambda self, score: weighed.append(len(score)) or real(self, score))
    A.analyse(rows, ss, 3, 4, bp_only=True)
    A.analyse(rows, ss, 3, 4)
    assert weighed == [2, 60 * 59 // 2]


def test_ancestors_and_clades(spark):
    rows = [("a", k, t) for k, t in enumerate(["AAAA", "AAAC", "GGGG", "GGGU"])]
    d = spark.createDataFrame(rows, "aln_id string, seq_id long, aseq string")
    nodes = {r.node: r for r in trees.ancestors(d).collect()}
    assert len(nodes) == 7 and [nodes[k].aseq for k in range(4)] == [t for *_, t in rows] and nodes[6].parent is None and nodes[6].seq_id is None
    cl = trees.clades(trees.build(d))
    sizes = {r.node: (r.n_leaves, r.height) for r in trees.node_times(cl).collect()}
    assert sizes[6][0] == 4 and sizes[4] == sizes[5] == (2, 0.125)
    lca = trees.lowest_common(cl, spark.createDataFrame([("a", 0, 1), ("a", 1, 2)], "aln_id string, a int, b int")).collect()
    assert {(r.a, r.b): sizes[r.node][0] for r in lca} == {(0, 1): 2, (1, 2): 4}
    subs = {r.col: r.nsubs for r in trees.column_subs(d).collect()}
    assert subs == {1: 1, 2: 1, 3: 1, 4: 3}
    assert [round(r.blen, 6) for r in trees.scale_branches(trees.build(d), "equal", 2.0).collect()] == [2.0] * 6


def test_grammars_stay_in_range():
    single, pair = T.emissions(0.9)
    seq = "".join(random.Random(1).choice("ACGU") for _ in range(2000))
    for g in (T.inside_g5(seq, T.RULES["g5"], single, pair), T.inside_g6(seq, T.RULES["g6"], single, pair), T.inside_g6(seq, T.RULES["g6x"], single, pair, None, True)):
        assert math.isfinite(g) and -2000 * math.log(16) < g < 0
    post = T.outside_g5("GGGGAAAACCCC" * 40, T.RULES["g5"], single, pair)
    assert (post.sum(0) + post.sum(1)).max() <= 1 + 1e-6 and T.inside_g6("", T.RULES["g6"], single, pair) == -math.inf


def plain_posteriors_g5(seq, t, single, pair):
    """Row by row, as the rules are written; for short sequences, whose numbers stay in range."""
    e1, e2, n = single[["ACGU".index(c) for c in seq]], pair[np.ix_(["ACGU".index(c) for c in seq], ["ACGU".index(c) for c in seq])], len(seq)
    s, o, post = np.zeros((n + 1, n + 1)), np.zeros((n + 1, n + 1)), np.zeros((n, n))
    s[range(n + 1), range(n + 1)] = t[2]
    for i in range(n - 1, -1, -1):
        s[i, i + 1 :] = t[0] * e1[i] * s[i + 1, i + 1 :]
        for k in range(i + 1, n):
            s[i, k + 1 :] += t[1] * e2[i, k] * s[i + 1, k] * s[k + 1, k + 1 :]
    o[0, n] = 1 / s[0, n]
    for i in range(n):
        o[i + 1, i + 1 :] += t[0] * e1[i] * o[i, i + 1 :]
        for k in range(i + 1, n):
            w, after = t[1] * e2[i, k], s[k + 1, k + 1 :] @ o[i, k + 1 :]
            o[i + 1, k] += w * after
            o[k + 1, k + 1 :] += w * s[i + 1, k] * o[i, k + 1 :]
            post[i, k] = w * s[i + 1, k] * after
    return post


def test_posteriors_of_many_sequences_at_once():
    single, pair = T.emissions(0.9)
    rnd = random.Random(7)
    seqs = ["".join(rnd.choice("ACGU") for _ in range(n)) for n in (0, 1, 2, 31, 32, 33, 63, 64, 65, 130)] + ["GGGGAAAACCCC" * 9]
    for s, got in zip(seqs, T.posteriors_g5(seqs, T.RULES["g5"], single, pair)):
        assert got.shape == (len(s), len(s)) and (not s or np.allclose(got, plain_posteriors_g5(s, T.RULES["g5"], single, pair), rtol=1e-9, atol=1e-12))
    # a scale that has to be looked for, beside one that has not
    one, long = T.posteriors_g5(["GGGAAACCC", "GC" * 700], T.RULES["g5"], single, pair)
    assert np.allclose(one, plain_posteriors_g5("GGGAAACCC", T.RULES["g5"], single, pair)) and 0.5 < (long.sum(0) + long.sum(1)).mean() <= 1 + 1e-6


def test_long_sequences_are_folded_by_blocks():
    """The work is in products of blocks: 1000 letters take some tenths of a second, a row at a time took ten seconds."""
    single, pair = T.emissions(0.9)
    seq = "".join(random.Random(8).choice("ACGU") for _ in range(1000))
    began = time.thread_time()
    T.mea_pairs(T.outside_g5(seq, T.RULES["g5"], single, pair))
    assert time.thread_time() - began < 4


def test_folded_rows_are_those_of_each_sequence(spark):
    rnd = random.Random(9)
    text = {k: "GGGGCC" * (k % 3) + "".join(rnd.choice("ACGU") for _ in range(k % 40)) + "GGCCCC" * (k % 3) for k in range(60)}
    single, pair = T.emissions(0.99)
    got = [tuple(r) for r in T.fold(spark.createDataFrame([*text.items(), (99, None), (98, "-.-")], "seq_id long, aseq string"), canonical=0.99).collect()]
    want = [(k, i, j) for k, s in text.items() if len(s) > 1 for i, j in T.mea_pairs(plain_posteriors_g5(s, T.RULES["g5"], single, pair))]
    assert sorted(got) == sorted(want) and len(want) > 0


def test_training_makes_sequences_likelier():
    single, pair = T.emissions(0.9)
    seqs = ["GGGAAACCC", "GCGCAAAAGCGC", "AUAUGGGGAUAU"]
    total = lambda t: sum(T.inside_g5(s, t, single, pair) for s in seqs)
    steps = [total(T.train_g5(seqs, k)) for k in range(5)]
    assert all(b >= a - 1e-9 for a, b in zip(steps, steps[1:])) and steps[-1] > steps[0]


def test_too_many_layers_are_refused():
    pairs = [(k, 100 - k, f"l{k:02}") for k in range(1, 28)]
    with pytest.raises(ValueError):
        T.to_wuss(pairs, 100)


def test_identities_in_blocks(spark):
    rng = np.random.default_rng(7)
    x = helix_rows(rng, 25, 12, [])
    cells = [("a", s, c, int(v)) for s, r in enumerate(x) for c, v in enumerate(r)] + [("b", 1, 1, 4)]
    d = spark.createDataFrame(cells, "aln_id string, seq long, col int, res int")
    want = {(a, b): int(((x[a] == x[b]) & (x[a] < 4)).sum()) for a, b in itertools.combinations(range(25), 2)}
    for block in (512, 6):
        assert {(r.a, r.b): r.same for r in X.pair_identity(d, 0.0, block).collect()} == want
    assert all(r.ident >= 0.5 for r in X.pair_identity(d, 0.5, 6).collect())


def test_marks_counts_and_contacts(spark):
    d = spark.createDataFrame([(0, True), (5, False), (12, True), (13, False), (14, True), (14, False)], "t int, c boolean")
    assert [r[0] for r in d.select(S.pair_mark(d.t, d.c)).collect()] == ["*", "**", "c~", "c", "~", " "]
    n = spark.createDataFrame([(5, 10), (50, 100), (500, 100)], "n int, a int")
    assert [r[0] for r in n.select(S.null_count(n.n, n.a)).collect()] == [100, 50, 20]
    atoms = spark.createDataFrame([("A", 1, 0.0, 0.0, 0.0), ("B", 4, 0.5, 0.0, 0.0), ("B", 5, 3.0, 0.0, 0.0), ("A", 2, 0.1, 0.0, 0.0), (None, 1, 0.0, 0.0, 0.0)], "chain string, resnum int, x double, y double, z double")
    assert {(r.chain_a, r.i, r.chain_b, r.j) for r in C.between_chains(atoms, 1.0).collect()} == {("A", 1, "B", 4), ("A", 2, "B", 4)}
    w = spark.createDataFrame([("a", 2), ("b", 1), ("c", None), ("d", 50)], "aln_id string, alen int")
    got = R.random_pairs(w, 30).collect()
    assert len(got) == 60 and all(1 <= r.i < r.j <= (2 if r.aln_id == "a" else 50) for r in got)
