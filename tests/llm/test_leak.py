import random

import pytest

from strandlake.llm import leak as L
from strandlake.llm.text import plain, sentences, word_hashes, words

DOC, ITEM = "doc_id long, text string, item_id long", "item_id long, passage string, doc_id long"


def test_words():
    assert words("<p>The <b>MO</b>lec\u00adular cl\u200bock’s Ｄéjà&nbsp;vu_x</p>") == ["the", "molecular", "clock", "s", "deja", "vu", "x"]
    assert words(None) == words("") == words(" ..\ufeff ") == []
    assert plain("a < b") == "a < b"


def test_sentences():
    t = "One is here. Two is there!\n>seq1\nACGUACGUACGUACGUACGUACGU\n# STOCKHOLM 1.0\nabc/1-20  ACGU--ACGU..ACGUACGUACGU\n//\n- Three follows.\n<p>Four.</p><p>Five</p>"
    assert [s.rstrip(".!") for s in sentences(t)] == ["One is here", "Two is there", "Three follows", "Four", "Five"]
    assert sentences(None) == sentences("") == sentences(" \n ") == []


def brute_in_order(p, t, share=0.75, stretch=1.5):
    width = int(len(p) * stretch)
    need = -(-len(p) * share // 1)
    for s in range(len(t)):
        w = t[s : s + width]
        row = [0] * (len(w) + 1)
        for x in p:
            prev = 0
            for j, y in enumerate(w, 1):
                prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
        if row[-1] >= need:
            return True
    return False


@pytest.mark.parametrize("seed", range(30))
def test_rules_against_brute_force(seed):
    rnd = random.Random(seed)
    p = [rnd.choice("abcdefghijklmnop") for _ in range(20)]
    t = [rnd.choice("abcdefghijklmnopq") for _ in range(15)] + [w for w in p if rnd.random() < rnd.choice([0.7, 0.8])] + ["q"] * 5
    assert L.in_order(p, t) == brute_in_order(p, t)
    runs = [n for n in range(21) if any(p[i : i + n] == t[j : j + n] for i in range(21 - n) for j in range(len(t) - n + 1))]
    assert L.longest_run(p, t) == max(runs)


def corpus(seed=1, items=20, docs=120):
    rnd = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    its = [(k, " ".join(rnd.choice(vocab) for _ in range(60)), 1) for k in range(items)]
    out = []
    for d in range(docs):
        body = [rnd.choice(vocab) for _ in range(150)]
        kind, (i, p, _) = rnd.randrange(6), rnd.choice(its)
        p = p.split()
        if kind == 0:
            body[50:50] = p
        elif kind == 1:
            body[50:50] = p[10:23]
        elif kind == 2:
            body[50:50] = p[10:22]
        elif kind == 3:
            body[50:50] = [w if rnd.random() > 0.12 else "zzz" for w in p]
        elif kind == 4:
            body[50:50] = rnd.sample(p, len(p))
        out.append((d, "<p>" + "  ".join(body).upper() + "</p>", i))
    return its + [(500, None, 1), (501, "", 1), (502, "only three words", 1)], out + [(900, None, 0), (901, "", 0), (902, "x only. THREE  words y", 0), out[0]]


@pytest.mark.parametrize("limit", [10**9, 0])
def test_both_ways_find_all(spark, limit):
    its, docs = corpus()
    got = [tuple(r) for r in L.leaks(spark.createDataFrame(docs, DOC), spark.createDataFrame(its, ITEM), broadcast_chars=limit).collect()]
    want = {(d, i) for d, t, _ in docs if t for i, p, _ in its if p and words(p) and L.holds(words(p), words(t))}
    assert len(got) == len(set(got)) and set(got) == want and (902, 502) in want and len(want) > 40


def test_empty(spark):
    its, docs = corpus()
    d, i = spark.createDataFrame(docs, DOC), spark.createDataFrame(its, ITEM)
    assert L.leaks(d.limit(0), i).collect() == [] and L.leaks(d, i.limit(0)).collect() == []


def test_short_items_are_found_on_both_paths(spark):
    filler = " ".join(f"w{k}" for k in range(40))
    docs = spark.createDataFrame([(1, f"{filler} red fox ran {filler}"), (2, f"{filler} one two new three four five six {filler}"), (3, filler)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "red fox ran"), (2, "one two three other five six")], "item_id long, passage string")
    for chars in (20_000_000, 0):
        assert {tuple(r) for r in L.leaks(docs, items, broadcast_chars=chars).collect()} == {(1, 1), (2, 2)}


def test_hashed_words_are_the_words():
    texts = [None, "", " \ufeff", "Straße ＡＢＣ a_b x1 2 <b>bo</b>ld Ñandú—“quoted” 100% \u00e9\u0301", "a" * 5000 + " b", "the the THE", "12 7 x"]
    h, off = word_hashes(texts)
    seen = {}
    for k, t in enumerate(texts):
        ws, got = words(t), h[off[k] : off[k + 1]].tolist()
        assert len(ws) == len(got)
        for w, x in zip(ws, got):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)
    alike, off = word_hashes(["12 7 x 7"], numbers_alike=True)
    assert alike[0] == alike[1] == alike[3] != alike[2]


def test_bound_of_pair_hits():
    """No pattern of kept words and insertions has fewer hit places than the bound says."""
    rnd = random.Random(3)
    for _ in range(4000):
        n = rnd.randint(1, 40)
        m = -(-n * 3 // 4)
        p = sorted(rnd.sample(range(n), m))
        width = int(n * 1.5)
        t = sorted(rnd.sample(range(width), m)) if width >= m else []
        hit = sum(b - a <= 2 and d - c <= 2 for a, b, c, d in zip(p, p[1:], t, t[1:]))
        assert hit >= L.least_pairs(n)
    assert L.least_pairs(60) == 14 and L.least_pairs(4) == L.least_pairs(1) == 0


def hard_cases():
    """Short items, repeated words, every fourth word dropped, a foreign word after every third, random losses and insertions."""
    rnd = random.Random(9)
    vocab = [f"v{k}" for k in range(300)]
    fill = lambda n: [f"f{rnd.randrange(2000)}" for _ in range(n)]
    items, docs = [], []
    for i, n in enumerate([1, 2, 3, 4, 5, 6, 7, 12, 13, 16, 24, 40, 61, 90]):
        for rep in range(3):
            p = [rnd.choice(vocab[: 300 if rep else 6]) for _ in range(n)]
            k = 10 * i + rep
            items.append((k, " ".join(p)))
            docs += [(100 * k, fill(30) + [w for j, w in enumerate(p) if j % 4 != 3] + fill(300)), (100 * k + 1, fill(5) + [x for j, w in enumerate(p) for x in ([w, "zz"] if j % 3 == 2 else [w])] + fill(5))]
            docs += [(100 * k + 2, fill(40) + p[: max(1, n // 3)] + fill(3) + p[n // 3 : n // 3 + 13] + fill(200))]
            for r in range(4):
                keep = [w for w in p if rnd.random() > 0.22]
                docs.append((100 * k + 3 + r, fill(20) + [x for w in keep for x in ([w] + ["qq"] * (rnd.random() < 0.45 * (r % 2)))] + fill(60)))
    return items, [(d, " ".join(t)) for d, t in docs]


@pytest.mark.parametrize("limit", [10**9, 0])
def test_hard_cases_equal_brute_force(spark, limit):
    items, docs = hard_cases()
    got = {tuple(r) for r in L.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, passage string"), broadcast_chars=limit).collect()}
    split = [(d, t.split()) for d, t in docs]
    want = {(d, i) for i, p in items for d, t in split if L.holds(p.split(), t)}
    assert got == want and len(want) > 150
