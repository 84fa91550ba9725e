import math
import random

import pytest

from strandlake.llm.topn import catalogue, cluster, top_hits, top_n

SCHEMA = "queryname string, hit_id long, e double, sc double, rank int, g string"


def brute(rows, n):
    best = {}
    for q, h, e, sc, *_ in set(rows):
        if q is None or e is None or math.isnan(e) or e < 0 or h is None:
            continue
        s = None if sc is None or math.isnan(sc) else sc
        best.setdefault(q, set()).add((e + 0.0, s is None, -s if s is not None else 0.0, h))
    return {(q, k[3]) for q, ks in best.items() for k in sorted(ks)[:n]}


def case(seed, size):
    rnd = random.Random(seed)
    rows = []
    for h in range(size):
        q = rnd.choice(["hot"] * 4 + [f"q{rnd.randrange(size // 3)}", None])
        e = rnd.choice([0.0, -0.0, 1e-5, 2e-5, 0.1, rnd.random(), None, float("nan"), -1.0])
        sc = rnd.choice([1.0, 2.5, rnd.random(), None, float("nan"), -3.0])
        rows.append((q, h, e, sc, 1, "x"))
    return rows + rows[:: max(1, size // 20)]  # some delivered twice


@pytest.mark.parametrize("seed,size,n", [(1, 3000, 5), (2, 300, 1), (3, 50, 100)])
def test_matches_brute_force(spark, seed, size, n):
    rows = case(seed, size)
    got = [(r.queryname, r.hit_id) for r in top_hits(spark.createDataFrame(rows, SCHEMA), n).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, n)


def test_many_row_groups_are_skipped(spark):
    rows = [("hot", h, float(h % 977) / 1000, 1.0, 1, "x") for h in range(40000)]
    d = spark.createDataFrame(rows, SCHEMA)
    path = cluster(d, "queryname", "hit_id", d.e, -d.sc, row_group_rows=512)
    c = catalogue(spark, path, 5)
    skipped = c.where("NOT wanted").count()
    assert c.count() >= 78 and skipped >= 0.8 * c.count()
    got = {r.id for r in top_n(spark, path, 5).collect()}
    assert got == {h for _, h in brute(rows, 5)}


def test_empty_and_zero(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert top_hits(empty).collect() == []
    assert top_hits(spark.createDataFrame([("a", 1, 0.1, 1.0, 1, "x")], SCHEMA), 0).collect() == []
    assert top_hits(spark.createDataFrame([("a", 1, None, 1.0, 1, "x")], SCHEMA)).collect() == []
