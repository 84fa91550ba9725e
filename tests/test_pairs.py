import itertools
import math
import random

import numpy as np
import pytest

from strandlake.operators import filters as X
from strandlake.operators import pairs as P

ROWS = [("a", 1, "ACGU"), ("a", 2, "GC-C"), ("a", 3, "ACGU"), ("a", 4, "U.NA")]


def cells(spark, rows=ROWS):
    code = {"A": 0, "C": 1, "G": 2, "U": 3}
    data = [(a, s, k + 1, code.get(c, 4)) for a, s, t in rows for k, c in enumerate(t)]
    return spark.createDataFrame(data, "aln_id string, seq long, col int, res int")


def brute(rows, i, j):
    w = np.zeros(16)
    for _, _, t in rows:
        a, b = "ACGU".find(t[i - 1]), "ACGU".find(t[j - 1])
        if a >= 0 and b >= 0:
            w[4 * a + b] += 1
    return w


def test_counts_both_ways(spark):
    want = {(i, j): brute(ROWS, i, j).tolist() for i, j in itertools.combinations(range(1, 5), 2)}
    got = {(r.i, r.j): r.w for r in P.joint_counts(cells(spark)).collect()}
    assert got == want
    rows = spark.createDataFrame([(a, s, t, None) for a, s, t in ROWS] + [("n", 9, None, None)], "aln_id string, seq long, aseq string, wgt double")
    assert {(r.i, r.j): r.w for r in P.joint_counts_rows(rows, chunk=2).collect()} == want


def test_probabilities_and_statistics(spark):
    rnd = random.Random(3)
    rows = [("a", s, "".join(rnd.choice("ACGU-") for _ in range(6))) for s in range(40)]
    pp = P.joint(P.joint_counts(cells(spark, rows)))
    got = P.with_marginals(pp).select("i", "j", "nseff", "ngap", "p", "e", *(P.covariation(s, c).alias(f"{s}_{c}") for s in P.STATS for c in ("C16", "C2")), P.covariation("gt", "CWC").alias("wc")).collect()
    w = {(r.i, r.j): (brute(rows, r.i, r.j) + 1e-10) for r in got}
    pn = {k: v / v.sum() for k, v in w.items()}
    m = np.zeros((7, 4))
    for (i, j), v in pn.items():
        m[i] += v.reshape(4, 4).sum(1)
        m[j] += v.reshape(4, 4).sum(0)
    m /= np.maximum(m.sum(1, keepdims=True), 1e-300)
    allowed = [x + y in (3, 5) for x in range(4) for y in range(4)]
    for r in got:
        p, e, n = pn[r.i, r.j], np.outer(m[r.i], m[r.j]).ravel(), r.nseff
        assert np.allclose(r.p, p) and np.allclose(r.e, e) and math.isclose(sum(r.p), 1)
        assert n + r.ngap == 40
        for cls in ("C16", "C2"):
            if cls == "C2":
                p, e = (np.array([v[allowed].sum(), v[~np.array(allowed)].sum()]) for v in (pn[r.i, r.j], np.outer(m[r.i], m[r.j]).ravel()))
            mi, h = (p * np.log(p / e)).sum(), -(p * np.log(p)).sum()
            want = {"chi": (n * (p - e) ** 2 / e).sum(), "omes": (n * (p - e) ** 2).sum(), "gt": 2 * n * mi, "mi": mi, "mir": mi / h, "mig": mi - r.ngap / n}
            assert all(math.isclose(r[f"{s}_{cls}"], v, rel_tol=1e-9, abs_tol=1e-9) for s, v in want.items())
        p, e = pn[r.i, r.j][allowed], np.outer(m[r.i], m[r.j]).ravel()[allowed]
        assert math.isclose(r.wc, 2 * n * (p * np.log(p / e)).sum(), rel_tol=1e-9, abs_tol=1e-9)


def test_raf_against_all_pairs_of_sequences(spark):
    rnd = random.Random(5)
    rows = [("a", s, "".join(rnd.choice("ACGU") for _ in range(4))) for s in range(12)]
    got = {(r.i, r.j): r.raf for r in P.raf(P.joint_counts(cells(spark, rows))).collect()}
    ok = {"AU", "UA", "GC", "CG", "GU", "UG"}
    for (i, j), v in got.items():
        q = [t[i - 1] + t[j - 1] for _, _, t in rows]
        change = sum((a[0] != b[0]) + (a[1] != b[1]) for a, b in itertools.combinations(q, 2) if a in ok and b in ok)
        assert math.isclose(v, 2 * change / (12 * 11) - sum(a not in ok for a in q) / 12)


def test_corrections_of_a_constant_are_zero(spark):
    d = spark.createDataFrame([("a", i, j, 2.5) for i, j in itertools.combinations(range(5), 2)], "aln_id string, i int, j int, v double")
    for r in P.correct(d, "v").collect():
        assert abs(r.v_apc) < 1e-12 and abs(r.v_asc) < 1e-12
    shifted = P.correct(d.withColumn("v", d.i * d.j + 1.0), "v", shift=True).collect()
    assert min(r.v_apc for r in shifted) == 0 and min(r.v_asc for r in shifted) == 0


def test_empty_and_single(spark):
    empty = spark.createDataFrame([], "aln_id string, seq long, col int, res int")
    assert P.with_marginals(P.joint(P.joint_counts(empty))).collect() == []
    gaps = cells(spark, [("g", 1, "--A"), ("g", 2, "--C")])
    got = P.with_marginals(P.joint(P.joint_counts(gaps))).select("nseff", P.covariation("mig").alias("v")).collect()
    assert len(got) == 3 and all(r.nseff == 0 and not math.isnan(r.v) for r in got)


def test_class_choice():
    assert [P.select_class(8, 51), P.select_class(9, 50), P.select_class(9, 51)] == ["C2", "C2", "C16"]


@pytest.mark.parametrize("f", [X.shuffle_columns, X.shuffle_within_columns, X.shuffle_within_rows])
def test_shuffles_keep_composition(spark, f):
    c = cells(spark, [("a", s, "ACGUACGU"[s : s + 4]) for s in range(4)])
    got = f(c, 5, 2).collect()
    for rep in (1, 2):
        assert sorted(r.res for r in got if r.rep == rep) == sorted(r.res for r in c.collect())


def test_filters_on_odd_rows(spark):
    rows = spark.createDataFrame([("a", 1, "AC-G~"), ("a", 2, "A--g."), ("a", 3, None), ("b", 4, ""), ("b", 5, "---")], "aln_id string, seq_id long, aseq string")
    assert [(r.aln_id, r.col, r.i) for r in X.keep_columns(rows).orderBy("col").collect()] == [("a", 1, 0), ("a", 2, 1), ("a", 4, 2)]
    st = {r.aln_id: r for r in X.msa_stats(rows).collect()}
    assert (st["a"].nseq, st["a"].alen, st["a"].n_runs, st["a"].max_run) == (3, 5, 3, 2)
    assert (st["b"].mean_len, st["b"].max_run) == (0.0, 3)
    w = X.pb_weights(rows).collect()
    assert math.isclose(sum(r.w for r in w), len(w))
    assert X.keep_columns(rows.limit(0)).collect() == []
