import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandlake.llm import pack as P


def optimum(sizes, capacity):
    best = len(sizes)

    def go(k, loads):
        nonlocal best
        if len(loads) >= best:
            return
        if k == len(sizes):
            best = len(loads)
            return
        for i in range(len(loads)):
            if loads[i] + sizes[k] <= capacity:
                go(k + 1, [*loads[:i], loads[i] + sizes[k], *loads[i + 1 :]])
        go(k + 1, [*loads, sizes[k]])

    go(0, [])
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=8))
def test_bound_and_packing_enclose_the_optimum(sizes):
    box = P.best_fit(np.array(sizes), 20)
    opt = optimum(sorted(sizes, reverse=True), 20)
    assert np.bincount(box, sizes).max() <= 20
    assert P.lower_bound(np.array(sizes), 20) <= opt <= box.max() + 1


def test_bound_beats_the_volume():
    assert P.lower_bound(np.array([11] * 5), 20) == 5 and P.lower_bound(np.array([7] * 6), 20) == 3
    assert P.lower_bound(np.array([], int), 20) == 0


@pytest.mark.parametrize("part_items", [10_000, 40])
def test_assignment_is_whole(spark, part_items):
    rng = np.random.default_rng(1)
    sizes = {k: int(v) for k, v in enumerate(rng.integers(1, 90, 300))} | {1000: 0, 1001: None, 1002: 100, 1003: 250, 1004: 1_000}
    d = spark.createDataFrame([(k, v, 1, "x") for k, v in sizes.items()] + [(3, sizes[3], 1, "x"), (None, 5, 1, "x")], "doc_id long, tokens long, part int, open string")
    rows = P.assign(d, 100, part_items=part_items, rounds=2).collect()
    load, seen = {}, {}
    for r in rows:
        if r.container_id is not None:
            load[r.container_id] = load.get(r.container_id, 0) + r.tokens
        seen.setdefault(r.doc_id, []).append((r.piece_no, r.start_token, r.tokens))
    assert max(load.values()) <= 100 and seen.keys() == sizes.keys()
    for k, pieces in seen.items():
        n, at = sizes[k] or 0, 0
        for no, (p, s, t) in enumerate(sorted(pieces), 1):
            assert (p, s) == (no, at)
            at += t
        assert at == n and len(pieces) == max(1, -(-n // 100))
    cert = P.certificates(P.assign(d, 100, part_items=part_items), 100, part_items).collect()
    assert all(c.bound <= c.containers for c in cert)
    pieces = np.array([r.tokens for r in rows if r.tokens])
    assert P.lower_bound(pieces, 100) <= len(load) <= 1.1 * P.lower_bound(pieces, 100) + 1


def test_empty(spark):
    d = spark.createDataFrame([], "doc_id long, tokens long")
    assert P.assign(d).collect() == []


def test_counts(spark):
    docs = spark.createDataFrame([(1, "GCAU <|endoftext|> word", "x"), (2, "", "x"), (3, None, "x"), (4, "né " * 30_000, "x"), (1, "GCAU <|endoftext|> word", "x")], "doc_id long, text string, t string")
    got = {r.doc_id: r.tokens for r in P.token_counts(docs).collect()}
    assert got[2] == got[3] == 0 and got[1] > 5 and got[4] >= 30_000 and len(got) == 4
    assert list(itertools.islice(got, 0)) == []
