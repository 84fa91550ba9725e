import itertools
import math

import numpy as np
import pytest

from strandlake.operators import contacts as C
from strandlake.operators import power as PW
from strandlake.operators import significance as S
from strandlake.operators import structure as T


def test_pipeline_orders_evalues_by_score(spark):
    rng = np.random.default_rng(0)
    null = spark.createDataFrame([("a", i, j, float(s)) for (i, j), s in zip(itertools.combinations(range(1, 31), 2), rng.exponential(1, 435))], "aln_id string, i int, j int, score double")
    real = null.withColumn("score", null.score * 1.5)
    frame = S.bin_frame(null)
    hist = S.histogram(null, frame)
    fit = S.fit_exponential(hist, S.tail(hist), frame)
    lam = fit.first().lam
    assert 0.5 < lam < 2
    ev = S.e_values(S.p_values(real, hist, fit, frame), spark.createDataFrame([("a", 1, 30)], "aln_id string, i int, j int"))
    rows = sorted(ev.collect(), key=lambda r: -r.score)
    p = [r.pval for r in rows]
    assert all(a <= b + 1e-12 for a, b in zip(p, p[1:])) and max(p) <= 1
    roc = sorted(S.roc(ev).collect(), key=lambda r: -r.score)
    assert [r.found for r in roc] == sorted(r.found for r in roc) and roc[-1].tp == roc[-1].true == 1
    capped = S.e_values(S.p_values(real, hist, fit, frame), spark.createDataFrame([], "aln_id string, i int, j int"), exp_bp=5)
    assert capped.count() == 435


def test_constant_scores(spark):
    d = spark.createDataFrame([("a", 1, j, 1.0) for j in range(2, 6)], "aln_id string, i int, j int, score double")
    frame = S.bin_frame(d)
    hist = S.histogram(d, frame)
    fit = S.fit_exponential(hist, S.tail(hist), frame)
    assert fit.first().lam is None
    # the highest filled bins count as one null score
    assert all(r.pval == 0.25 for r in S.p_values(d, hist, fit, frame).collect())


def test_combinations():
    assert PW.fisher([0.3]) == PW.sidak([0.3]) * 1.0 or math.isclose(PW.fisher([0.3]), PW.sidak([0.3]))
    p = [0.05, 0.05]
    assert math.isclose(PW.fisher(p), 0.0025 * (1 - math.log(0.0025)), rel_tol=1e-9)
    assert math.isclose(PW.lancaster(p, [2, 2]), PW.fisher(p), rel_tol=1e-6)
    assert math.isclose(PW.weighted_fisher(p, [0.4, 0.4]), PW.fisher(p), rel_tol=1e-6)
    assert PW.sidak([1e-10, 0.5]) == pytest.approx(2e-10, rel=1e-3)


@pytest.mark.parametrize("method", ["fisher", "sidak", "lancaster", "wfisher"])
def test_combine_in_spark(spark, method):
    rows = [("a", 1, 0.05, 3, 0.2), ("a", 1, 0.2, 5, 0.6), ("a", 2, 0.9, 0, 0.0), ("a", 3, None, 1, 0.1)]
    got = {r.motif: r for r in PW.combine(spark.createDataFrame(rows, "aln_id string, motif int, pval double, nsubs int, power double"), method).collect()}
    want = {"fisher": PW.fisher([0.05, 0.2]), "sidak": PW.sidak([0.05, 0.2]), "lancaster": PW.lancaster([0.05, 0.2], [4, 6]), "wfisher": PW.weighted_fisher([0.05, 0.2], [0.2, 0.6])}[method]
    assert set(got) == {1, 2} and math.isclose(got[1].pval, want, rel_tol=1e-9) and math.isclose(got[1].evalue, 2 * want, rel_tol=1e-9)


def test_power_steps(spark):
    d = spark.createDataFrame([(s,) for s in (0, 5, 6, 10, 11, 20, 21)], "s long")
    got = [r.p for r in d.select(PW.lookup(d, "s", [(0, 0.0), (5, 0.1), (10, 0.5), (20, 0.9)]).alias("p")).collect()]
    assert got == [0.0, 0.0, 0.1, 0.1, 0.5, 0.5, 0.9]


def test_wuss():
    s = "<<((A..))>>[a]{}"
    pairs = T.parse_wuss(s)
    assert (5, 13, "pkA") in pairs and len(pairs) == 7
    assert T.parse_wuss(T.to_wuss(pairs, len(s))) == pairs
    assert T.parse_wuss(">><") == [] and T.parse_wuss(None) == []


def test_layers_are_nested_and_complete():
    pairs = [(1, 10, 1e-5), (2, 9, 1e-4), (5, 12, 1e-6), (3, 8, 0.5)]
    got = T.layers(pairs, 0.05)
    assert len(got) == 2 and sorted(p for layer in got for p in layer) == [(1, 10), (2, 9), (5, 12)]
    for layer in got:
        assert not any(a < c < b < d for (a, b), (c, d) in itertools.permutations(layer, 2))


def _brute_g5(seq, t, single, pair):
    if not seq:
        return t[2]
    total = t[0] * single["ACGU".index(seq[0])] * _brute_g5(seq[1:], t, single, pair)
    for k in range(1, len(seq)):
        total += t[1] * pair["ACGU".index(seq[0]), "ACGU".index(seq[k])] * _brute_g5(seq[1:k], t, single, pair) * _brute_g5(seq[k + 1 :], t, single, pair)
    return total


def test_inside_g5_and_posteriors():
    t, single, pair = (0.4, 0.3, 0.3), np.array([0.4, 0.2, 0.2, 0.2]), np.full((4, 4), 1 / 16)
    pair[0, 3] += 0.2
    pair /= pair.sum()
    for s in ("A", "AU", "ACGU", "GAUCA"):
        assert math.isclose(T.inside_g5(s, t, single, pair), math.log(_brute_g5(s, t, single, pair)), rel_tol=1e-9)
    post = T.outside_g5("ACGUA", t, single, pair)
    assert (post >= 0).all() and ((post.sum(0) + post.sum(1)) <= 1 + 1e-9).all()
    assert all(i < j for i, j in T.mea_pairs(post))


def test_g6_variants():
    single, pair = np.full(4, 0.25), np.full((4, 4), 1 / 16)
    t = {"S": (0.6, 0.4), "L": (0.3, 0.7), "F": (0.6, 0.4)}
    assert math.isclose(T.inside_g6("A", t, single, pair), math.log(0.4 * 0.7 * 0.25))
    # with flat stacking the stacked grammar is the plain one
    seq = "GGGAAACCC"
    assert math.isclose(T.inside_g6(seq, t, single, pair), T.inside_g6(seq, t, single, pair, np.full((16, 16), 1 / 16)), rel_tol=1e-9)
    tx = {"S": (0.6, 0.4), "L": (0.2, 0.1, 0.7), "F": (0.5, 0.1, 0.4)}
    assert np.isfinite(T.inside_g6(seq, tx, single, pair, None, True))


def test_grid_contacts_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    xyz = rng.uniform(-1, 1, (60, 3))
    rows = [("c", k // 2, *map(float, v)) for k, v in enumerate(xyz)] + [("c", 99, None, 0.0, 0.0)]
    got = {(r.i, r.j): r.dist for r in C.from_atoms(spark.createDataFrame(rows, "aln_id string, resnum int, x double, y double, z double"), 0.4, 2).collect()}
    want = {}
    for a, b in itertools.product(range(60), repeat=2):
        i, j, d = a // 2, b // 2, float(np.linalg.norm(xyz[a] - xyz[b]))
        if j - i + 1 > 2 and d < 0.4:
            want[i, j] = min(d, want.get((i, j), 9))
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in got)


def test_compatible(spark):
    pairs = spark.createDataFrame([("a", 1, 9), ("a", 2, 5), ("a", 3, 6)], "aln_id string, i int, j int")
    ct = spark.createDataFrame([("a", 1, 4)], "aln_id string, i int, j int")
    assert sorted((r.i, r.j) for r in T.compatible(pairs, ct).collect()) == [(2, 5), (3, 6)]
