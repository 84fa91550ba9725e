import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from strandlake.operators.skew_profile import exact_quantiles, key_profile


def brute(values, prob):
    v = sorted(values)
    return v[max(1, math.ceil(prob * len(v))) - 1]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dictionaries(st.sampled_from("abc"), st.lists(st.one_of(st.integers(-5, 5).map(float), st.floats(-1e300, 1e300)), min_size=1, max_size=30), min_size=1))
def test_quantiles_are_exact(spark, data):
    rows = [(k, float(v), 1) for k, vs in data.items() for v in vs]
    got = {(r.key, r.prob): r["quantile"] for r in exact_quantiles(spark.createDataFrame(rows, "key string, v double, n long"), (0.1, 0.5, 1.0), bins=4).collect()}
    assert got == {(k, p): brute(vs, p) for k, vs in data.items() for p in (0.1, 0.5, 1.0)}


def test_quantiles_of_a_hot_key_and_odd_values(spark):
    rnd = random.Random(1)
    hot = [float(rnd.randrange(100000)) for _ in range(5000)]
    rows = [("hot", v, 1) for v in hot] + [("one", 3.0, 7), (None, 1.0, 1), ("nan", float("nan"), 1), ("null", None, 1)]
    got = {(r.key, r.prob): r["quantile"] for r in exact_quantiles(spark.createDataFrame(rows, "key string, v double, n long"), (0.5, 0.99)).collect()}
    assert got == {("hot", 0.5): brute(hot, 0.5), ("hot", 0.99): brute(hot, 0.99), ("one", 0.5): 3.0, ("one", 0.99): 3.0}


def test_quantiles_of_nothing(spark):
    assert exact_quantiles(spark.createDataFrame([], "key string, v double, n long"), (0.5,)).collect() == []


@pytest.mark.parametrize("empty", [False, True])
def test_profile(spark, empty):
    rows = [] if empty else [(1, "A", 3), (2, "A", None), (3, "B", 5), (4, "X", 9), (5, None, 2)]
    alns = [] if empty else [("A", "fam", 2, -1), ("B", "fam", None, 7), ("C", "lone", 1, 1), ("X", None, 1, 1)]
    r = spark.createDataFrame(rows, "id long, aln string, name int")  # a size column of a clashing name
    a = spark.createDataFrame(alns, "aln string, name string, x int, y int")
    prof, n, c = key_profile(r, "id", "aln", "name", a, "aln", "name", ("x", "y"), (0.5,))
    got = {tuple(x) for x in prof.collect()}
    if empty:
        assert (got, n, c) == (set(), 0, 0)
    else:
        assert (n, c) == (5, 19)
        assert got == {("fam", 2, 2, 7, 3, 8, 3), ("lone", 1, 1, 1, 0, 0, None)}
