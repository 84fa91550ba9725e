import random
import re

import pytest
from hypothesis import given
from hypothesis import strategies as st

from strandlake.llm.split import merge, pack, parse, rejoin, split_rows


def brute(a, limit=400, overlap=40, least=200):
    ends = [c for c in range(3, len(a)) if all(x in "-._~" for x in a[c - 3 : c]) and a[c].isalpha()]
    out, s = [], 1
    while True:
        if len(a) <= s + limit - 1:
            return [*out, (s, len(a))]
        ok = [c for c in ends if s + least <= c <= s + limit - 1]
        e = max(ok) if ok else s + limit - 1
        out.append((s, e))
        s = e - overlap + 1


def aligned(rnd, n):
    out = ""
    while len(out) < n:
        out += "".join(rnd.choice("ACGUacgtN") for _ in range(rnd.randrange(1, rnd.choice([5, 60, 300])))) + rnd.choice("-._~") * rnd.choice([1, 2, 3, 4, 20, 250])
    return out[:n]


@pytest.mark.parametrize("seed", range(40))
def test_pack_matches_the_rule(seed):
    rnd = random.Random(seed)
    a = aligned(rnd, rnd.choice([1, 400, 401, 799, 1500, 5000]))
    assert pack(a) == brute(a) and rejoin(a, pack(a)) == a


@given(st.text("AC-~1", max_size=120))
def test_pack_of_small_limits(a):
    assert pack(a, 20, 4, 8) == brute(a, 20, 4, 8)
    assert rejoin(a, pack(a, 20, 4, 8)) == a


def shape(n):
    return (n.start, n.end, [shape(k) for k in n.kids]) if n.kids else (n.start, n.end)


def test_tree_levels():
    a = "AAA" + "-" * 3 + "CC" + "." * 15 + "GG" + "~~~" + "U" + "-" * 50 + "A"
    assert shape(parse(a)) == (0, 80, [(0, 79, [(0, 23, [(0, 6), (6, 23)]), (23, 79, [(23, 28), (28, 79)])]), (79, 80)])


def test_merging_is_bottom_up():
    a = "".join(("A" * 6 + "---") for _ in range(8)) + "A"
    tree = merge(parse(a, (3,)), 20)
    assert shape(tree) == (0, 73, [(0, 18, [(0, 9), (9, 18)]), (18, 36, [(18, 27), (27, 36)]), (36, 54, [(36, 45), (45, 54)]), (54, 73, [(54, 72, [(54, 63), (63, 72)]), (72, 73)])]) and tree.kids[0].merged


def test_the_tree_decides_where_levels_count():
    """A chapter's end comes before a later end of a segment; by the plain rule the later one wins."""
    a = "A" * 200 + "-" * 60 + "C" * 60 + "---" + "G" * 300
    assert pack(a)[0] == (1, 323) and pack(a, by_level=True)[0] == (1, 260)
    assert rejoin(a, pack(a, by_level=True)) == a
    rnd = random.Random(2)
    differ = 0
    for _ in range(30):
        x = aligned(rnd, 3000)
        got = pack(x, by_level=True)
        assert rejoin(x, got) == x and all(e - s < 400 for s, e in got) and all(e2 - 39 == s for (_, e2), (s, _) in zip(got, got[1:]))
        differ += got != pack(x)
    assert differ > 10


def test_rows(spark):
    a = aligned(random.Random(9), 2000)
    rows = [(1, a, 5), (1, a, 5), (2, "A" * 400, 900), (3, None, 900), (4, "", 900), (None, a, 1), (5, "-" * 900, 1)]
    got = sorted(tuple(r) for r in split_rows(spark.createDataFrame(rows, "seq_id long, aseq string, k int"), "seq_id", "aseq").collect())
    want = [(i, n, s, e) for i, t in ((1, a), (5, "-" * 900)) for n, (s, e) in enumerate(brute(t), 1)]
    assert got == want
    assert split_rows(spark.createDataFrame([], "seq_id long, aseq string"), "seq_id", "aseq").collect() == []
    with pytest.raises(ValueError):
        split_rows(spark.createDataFrame(rows, "seq_id long, aseq string, k int"), "seq_id", "aseq", overlap=300)


def test_very_long_row():
    a = aligned(random.Random(4), 400_000)
    assert pack(a) == brute(a) if len(a) < 50_000 else rejoin(a, pack(a)) == a and all(e - s < 400 for s, e in pack(a))
    assert not re.search("x", a)
