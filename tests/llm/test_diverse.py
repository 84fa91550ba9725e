import itertools
import random

import numpy as np

from strandlake.llm import diverse as D

SEQS = "seq_id long, aln_id string, aseq string, wgt double, least double, nb int"
CFG = "cfg_id long, aln_id string, idthresh double, n_want int, gapthresh double, b int"


def ident(x, y):
    x, y = (s.upper().replace("T", "U") for s in (x, y))
    same = sum(a == b and a.isalpha() for a, b in zip(x, y))
    return same / min(sum(map(str.isalpha, x)), sum(map(str.isalpha, y)))


def data(seed=1, n=40):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice("ACGUacgtN-.~") for _ in range(30)) for _ in range(4)]
    rows = []
    for k in range(n):
        b = list(rnd.choice(base))
        for _ in range(rnd.randrange(8)):
            b[rnd.randrange(30)] = rnd.choice("ACGU-")
        rows.append((k, "A" if k % 3 else "B", "".join(b)[: rnd.choice([30, 30, 20])], rnd.choice([1.0, 0.4, None, float("nan"), -1.0]), 0.0, 1))
    return rows + [(900, "A", None, 1.0, 0.0, 1), (901, "A", "---", 1.0, 0.0, 1), (902, None, "ACGU", 1.0, 0.0, 1), rows[3], rows[4]]


CONF = [(1, "A", 0.8, 5, 0.5, 1), (2, "A", 60.0, 9, 0.5, 1), (3, "B", 1.0, 4, 0.5, 1), (4, "B", -1.0, 4, 0.5, 1), (5, "B", None, 4, 0.5, 1), (6, "Z", 0.5, 4, 0.5, 1), (7, "B", 0.0, 3, 0.5, 1), (1, "A", 0.8, 5, 0.5, 1), (8, None, 0.5, 2, 0.5, 1), (9, "A", 100.0, None, 0.5, 1)]


def want():
    rows = {k: (a, s) for k, a, s, *_ in data() if s and any(c.isalpha() for c in s) and a}
    out = set()
    for c, a, t, *_ in CONF:
        if a and t is not None and t >= 0 and t != 1:
            t = t / 100 if t > 1 else t
            ids = sorted(k for k, v in rows.items() if v[0] == a)
            out |= {(c, i, j) for i, j in itertools.combinations(ids, 2) if ident(rows[i][1], rows[j][1]) >= t}
    return out


def test_pairs_in_blocks(spark):
    s, c = spark.createDataFrame(data(), SEQS), spark.createDataFrame(CONF, CFG)
    for block in (512, 7):
        got = [tuple(r) for r in D.similar_pairs(s, c, block).collect()]
        assert len(got) == len(set(got)) and set(got) == want()
    assert D.similar_pairs(s.limit(0), c).collect() == [] and D.similar_pairs(s, c.limit(0)).collect() == []


def test_choice_keeps_the_rules(spark):
    s, c = spark.createDataFrame(data(), SEQS), spark.createDataFrame(CONF, CFG)
    bad = want()
    n_want = {k: n for k, _, _, n, *_ in CONF}
    for part in (512, 8):
        got = {}
        for r in D.choose(s, c, part).collect():
            got.setdefault(r.cfg_id, []).append(r.seq_id)
        assert set(got) == {1, 2, 3, 4, 5, 7}
        for k, ids in got.items():
            assert len(ids) == len(set(ids)) <= n_want[k]
            assert not any((k, i, j) in bad for i, j in itertools.combinations(sorted(ids), 2))
        assert len(got[3]) == 4  # with the filter off there are rows enough
    assert D.choose(s.limit(0), c).collect() == []


def test_greedy_maximises_the_determinant():
    rnd = np.random.default_rng(5)
    x = rnd.integers(1, 5, (9, 40)).astype(np.uint8)
    q = rnd.uniform(0.5, 1.5, 9)
    n = np.full(9, 40.0)
    k = np.outer(q, q) * (x[:, None, :] == x[None, :, :]).sum(2) / 40
    got = D.greedy(x, n, q, None, 4)
    for m in range(1, 5):
        best = max((j for j in range(9) if j not in got[: m - 1]), key=lambda j: np.linalg.det(k[np.ix_([*got[: m - 1], j], [*got[: m - 1], j])]))
        assert best == got[m - 1]


def test_distances_keep_no_alike_rows_apart():
    rnd = np.random.default_rng(8)
    x = rnd.integers(0, 5, (40, 60)).astype(np.uint8)
    x[20:] = np.where(rnd.random((20, 60)) < 0.2, rnd.integers(0, 5, (20, 60)), x[:20])
    n = (x > 0).sum(1)
    far = D.distances(x, x)
    same = D.matches(x, x)
    for t in (0.0, 0.3, 0.6, 0.9):
        alike = same / np.minimum(n[:, None], n) >= t
        assert (far[alike] <= D.most_apart(n[:, None], n, t)[alike]).all()
    assert (far[:, None, :] <= far[:, :, None] + far[None]).all()  # the triangle inequality


def test_large_alignment_in_cells(spark):
    rnd = random.Random(4)
    base = ["".join(rnd.choice("ACGU") for _ in range(80)) for _ in range(6)]
    rows = []
    for k in range(300):
        b = list(base[k % 6])
        for _ in range(rnd.randrange(14)):
            b[rnd.randrange(80)] = rnd.choice("ACGU-")
        rows.append((k, "A", "".join(b), 1.0))
    s = spark.createDataFrame(rows, "seq_id long, aln_id string, aseq string, wgt double")
    c = spark.createDataFrame([(1, "A", 0.85, 5)], "cfg_id long, aln_id string, idthresh double, n_want int")
    want = {(1, i, j) for i, j in itertools.combinations(range(300), 2) if ident(rows[i][2], rows[j][2]) >= 0.85}
    got = [tuple(r) for r in D.similar_pairs(s, c, 24).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 1000
