"""Held-out passages inside a corpus, by spaced-seed hashing.

A seed is a fixed mask over consecutive words: the words under its ones are hashed, those under
its zeros are ignored, so a hit survives substitutions there. Hits of test and training seeds name
documents and items, and the exact rules are then checked around the hits.

Both kinds of masks lose nothing. A run of ``run`` kept words holds every word under the long mask. And of two
neighbouring kept words of a passage the pair masks join those at most 2 apart on both sides: since the stretch is
bounded, so many neighbours must be that near that ``least_pairs`` places of the passage are hit.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.text import in_chunks, mixed, word_hashes

#: Mask of weight 5 for runs; its span may be at most the run.
LONG = "1101011"
#: Masks of weight 2: the next word, and the next but one.
PAIRS = ("11", "101")
#: What a hit proves: a run may be there, one place of the passage, or (passages too short for a bound) that a word is shared.
RUN, PLACE, WORD = 0, 1, 2


def least_pairs(n: int, share: float = 0.75, stretch: float = 1.5) -> int:
    """Places of a passage of n words that pair masks hit at least, if ``share`` of its words stand in order in ``stretch`` times its length.

    Of m kept words the m-1 steps to the next take at most n-1 places in the passage and the stretch less one in the text, together;
    a step that no mask joins takes at least 4, any other 2.
    """
    m = int(-(-n * share // 1))
    return max(0, -(-(4 * (m - 1) - (n - 1) - (int(n * stretch) - 1)) // 2))


def seeds(h: np.ndarray, off: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Hash at every place at which the mask fits into one text, and the place; texts lie one after the other, offsets given."""
    n, ones = len(h) - len(mask) + 1, [j for j, bit in enumerate(mask) if bit == "1"]
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    s = np.full(n, len(ones), np.uint64)
    for j in ones:
        s = s * np.uint64(0xD1342543DE82EF95) + h[j : j + n]
    ok = np.ones(n, bool)
    for k in range(1, len(mask)):
        cut = off[1:-1] - k
        ok[cut[(cut >= 0) & (cut < n)]] = False
    at = np.flatnonzero(ok)
    return mixed(s[at]), at


def longest_run(p: list, t: list) -> int:
    """Most consecutive words of p that stand consecutively in t."""
    at = defaultdict(list)
    for j, w in enumerate(t):
        at[w].append(j)
    best, prev = 0, {}
    for w in p:
        cur = {j: prev.get(j - 1, 0) + 1 for j in at.get(w, ())}
        if cur:
            best = max(best, max(cur.values()))
        prev = cur
    return best


def in_order(p: list, t: list, share: float = 0.75, stretch: float = 1.5) -> bool:
    """Whether ``share`` of p's words stand in the same order within a stretch of at most ``stretch`` times its length."""
    need, width = -(-len(p) * share // 1), int(len(p) * stretch)
    mask: dict = defaultdict(int)
    for i, w in enumerate(p):
        mask[w] |= 1 << i
    hits = [j for j, w in enumerate(t) if w in mask]
    if len(hits) < need:
        return False
    full = (1 << len(p)) - 1
    k = 0
    for i, s in enumerate(hits):
        while k < len(hits) and hits[k] < s + width:
            k += 1
        if k - i < need:
            continue
        # longest common subsequence of p and the stretch that starts at s, by bits
        v = full
        for j in hits[i:k]:
            m = mask[t[j]]
            u = v & m
            v = ((v + u) | (v - u)) & full
        if len(p) - v.bit_count() >= need:
            return True
    return False


def holds(p: list, t: list, run: int = 13, share: float = 0.75, stretch: float = 1.5) -> bool:
    return longest_run(p, t) >= run or in_order(p, t, share, stretch)


def _item_seeds(h: np.ndarray, off: np.ndarray, run: int, share: float, stretch: float) -> tuple[np.ndarray, ...]:
    """(seed, text, place, kind) of passages: those of the long mask, of the pair masks, and the words of passages without a bound."""
    text = np.repeat(np.arange(len(off) - 1), np.diff(off))
    long_ = LONG if run >= len(LONG) else "1" * run
    out = []
    for kind, mask in ((RUN, long_), *((PLACE, m) for m in PAIRS)):
        s, at = seeds(h, off, mask)
        out.append((s, text[at], at - off[text[at]], np.full(len(s), kind)))
    short = np.array([least_pairs(n, share, stretch) < 1 for n in np.diff(off)], bool)
    at = np.flatnonzero(short[text]) if len(text) else np.zeros(0, np.int64)
    out.append((mixed(h[at]), text[at], np.zeros(len(at), np.int64), np.full(len(at), WORD)))
    return tuple(np.concatenate(x) for x in zip(*out))


def _text_seeds(h: np.ndarray, off: np.ndarray, run: int, singles: bool) -> tuple[np.ndarray, np.ndarray]:
    """(seed, place in all words) of corpus texts, single words only where an item needs them."""
    long_ = LONG if run >= len(LONG) else "1" * run
    got = [seeds(h, off, m) for m in (long_, *PAIRS)]
    if singles:
        got.append((mixed(h), np.arange(len(h))))
    return np.concatenate([s for s, _ in got]), np.concatenate([p for _, p in got])


class Items:
    """The held-out passages as sorted seeds and hashed words."""

    def __init__(self, rows: list[tuple[int, str | None]], run: int = 13, share: float = 0.75, stretch: float = 1.5):
        self.rule = (run, share, stretch)
        self.ids = np.array([i for i, _ in rows], np.int64)
        h, off = word_hashes([p for _, p in rows])
        self.words = [h[a:b].tolist() for a, b in zip(off[:-1], off[1:])]
        self.least = np.array([least_pairs(len(w), share, stretch) for w in self.words], np.int64)
        self.width = np.array([int(len(w) * stretch) for w in self.words], np.int64)
        seed, item, place, kind = _item_seeds(h, off, *self.rule)
        pairs = kind == PLACE
        order = np.argsort(seed[pairs], kind="stable")
        self.seed, self.item, self.place = seed[pairs][order], item[pairs][order], place[pairs][order]
        self.vocab, at = np.unique(h, return_inverse=True)
        self.count = np.zeros((len(self.vocab), len(rows)), np.uint16)  # how often a passage has each word
        np.add.at(self.count, (at, np.repeat(np.arange(len(rows)), np.diff(off))), 1)
        order = np.argsort(seed[~pairs], kind="stable")
        self.sure, self.sure_item, self.sure_kind = seed[~pairs][order], item[~pairs][order], kind[~pairs][order]
        self.sure_at = (off[item] + place)[~pairs][order]  # place among the words of all passages
        self.singles = bool((kind == WORD).any())
        self.bits = max(10, int(np.ceil(np.log2(len(seed) + 1))) + 5)
        self.seen = np.zeros(1 << self.bits, bool)  # most seeds of a corpus end here
        self.seen[seed & np.uint64((1 << self.bits) - 1)] = True

    def _covered(self, known: np.ndarray, known_row: np.ndarray, items: np.ndarray) -> np.ndarray:
        """Which of the items, of like stretches, have ``share`` of their words, in any order, within the widest of the stretches somewhere in a text.

        known: places of the text's words that some passage has, known_row: which they are. An occurrence counts from its place until the stretch has passed or the word comes again, so that it counts once.
        """
        width, out = int(self.width[items].max()), np.zeros(len(items), bool)
        need = np.array([-(-len(self.words[i]) * self.rule[1] // 1) for i in items.tolist()])
        for first in range(0, len(known), 20_000):  # texts of any length in bounded memory
            last = np.searchsorted(known, known[min(first + 20_000, len(known)) - 1] + width)
            at, row = known[first:last], known_row[first:last]
            order, end = np.argsort(row, kind="stable"), at + width
            again = row[order[:-1]] == row[order[1:]]
            end[order[:-1][again]] = np.minimum(end[order[:-1][again]], at[order[1:][again]])
            count = self.count[np.ix_(row, items)]
            by_end = np.argsort(end, kind="stable")
            gone = np.concatenate([np.zeros((1, len(items)), np.int32), np.cumsum(count[by_end], axis=0, dtype=np.int32)])
            have = np.cumsum(count, axis=0, dtype=np.int32) - gone[np.searchsorted(end[by_end], at, "right")]
            out |= have.max(0) >= need
        return out

    def near(self, h: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, item) numbers of all pairs that enough seeds name."""
        s, at = _text_seeds(h, off, self.rule[0], self.singles)
        some = self.seen[s & np.uint64((1 << self.bits) - 1)]
        s, at = s[some], at[some]
        lo, hi = np.searchsorted(self.sure, s, "left"), np.searchsorted(self.sure, s, "right")
        text = np.searchsorted(off, at, "right") - 1
        n = hi - lo
        row = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
        where, whose, run_ = np.repeat(at, n), self.sure_item[row], self.sure_kind[row] == RUN
        found = {*zip(np.repeat(text, n)[~run_].tolist(), whose[~run_].tolist())}
        # a run is so many hits in a row on one diagonal
        where, whose, slant = where[run_], whose[run_], where[run_] - self.sure_at[row][run_]
        order = np.lexsort((where, slant))
        where, whose, slant, more = where[order], whose[order], slant[order], max(0, self.rule[0] - len(LONG))
        k = np.arange(len(where) - more) if len(where) > more else np.zeros(0, np.int64)
        k = k[(slant[k] == slant[k + more]) & (where[k + more] - where[k] == more)]
        found.update(zip((np.searchsorted(off, where[k], "right") - 1).tolist(), whose[k].tolist()))
        lo, hi = np.searchsorted(self.seed, s, "left"), np.searchsorted(self.seed, s, "right")
        some = hi > lo
        key = np.sort(text[some] * (len(self.seed) + 1) + lo[some])  # a seed counts once in a text
        key = key[np.diff(key, prepend=-1) > 0]
        text, lo = key // (len(self.seed) + 1), key % (len(self.seed) + 1)
        n = np.searchsorted(self.seed, self.seed[lo], "right") - lo
        row = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        longest = int(self.place.max(initial=0)) + 1
        key = np.sort((np.repeat(text, n) * len(self.ids) + self.item[row]) * longest + self.place[row])
        key = key[np.diff(key, prepend=-1) > 0] // longest  # different places
        first = np.flatnonzero(np.diff(key, prepend=-1))
        pair, count = key[first], np.diff(first, append=len(key))
        pair = pair[count >= np.maximum(1, self.least[pair % len(self.ids)])]
        row = np.minimum(np.searchsorted(self.vocab, h), max(0, len(self.vocab) - 1))
        known = np.flatnonzero(self.vocab[row] == h) if len(self.vocab) else row[:0]
        row, ends = row[known], np.searchsorted(known, off)
        for group in np.split(pair, np.flatnonzero(np.diff(pair // len(self.ids))) + 1) if len(pair) else ():
            t, like = int(group[0]) // len(self.ids), group % len(self.ids)
            like = like[np.argsort(self.width[like], kind="stable")]
            for i in np.split(like, np.flatnonzero(np.diff(self.width[like] // 12)) + 1):
                found.update((t, x) for x in i[self._covered(known[ends[t] : ends[t + 1]], row[ends[t] : ends[t + 1]], i)].tolist())
        out = np.array(sorted(found), np.int64).reshape(-1, 2)
        return out[:, 0], out[:, 1]


def _scan(items, run: int, share: float, stretch: float):
    def f(batches):
        it = items.value
        for b in batches:
            ids = b.column(0).to_pylist()
            for first, texts in in_chunks(b.column(1).to_pylist()):
                h, off = word_hashes(texts)
                doc, item = [], []
                for t, i in zip(*(x.tolist() for x in it.near(h, off))):
                    if holds(it.words[i], h[off[t] : off[t + 1]].tolist(), run, share, stretch):
                        doc.append(ids[first + t])
                        item.append(int(it.ids[i]))
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(item, pa.int64())], names=["doc_id", "item_id"])

    return f


def _emit_items(run: int, share: float, stretch: float):
    """(id, passage) -> (item, seed, place, kind, least)"""

    def f(batches):
        for b in batches:
            ids = b.column(0).to_numpy()
            for first, texts in in_chunks(b.column(1).to_pylist()):
                h, off = word_hashes(texts)
                s, t, place, kind = _item_seeds(h, off, run, share, stretch)
                least = np.array([max(1, least_pairs(n, share, stretch)) for n in np.diff(off)], np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(ids[first + t]), pa.array(s.view(np.int64)), pa.array(place.astype(np.int32)), pa.array(kind.astype(np.int32)), pa.array(least[t])], names=["item", "seed", "place", "kind", "least"])

    return f


def _emit_texts(run: int, singles: bool):
    """(id, text) -> (doc, seed): all different seeds of each text"""

    def f(batches):
        for b in batches:
            ids = b.column(0).to_numpy()
            for first, texts in in_chunks(b.column(1).to_pylist()):
                h, off = word_hashes(texts)
                s, at = _text_seeds(h, off, run, singles)
                t = np.searchsorted(off, at, "right") - 1
                order = np.lexsort((s, t))
                s, t = s[order], t[order]
                new = np.ones(len(s), bool)
                new[1:] = (s[1:] != s[:-1]) | (t[1:] != t[:-1])
                s, t = s[new], t[new]
                for a in range(0, len(s), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[first + t[a : a + 100_000]]), pa.array(s[a : a + 100_000].view(np.int64))], names=["doc", "seed"])

    return f


def _check(run: int, share: float, stretch: float):
    def f(batches):
        for b in batches:
            p, t = b.column(2).to_pylist(), b.column(3).to_pylist()
            ok = []
            for a, x in zip(p, t):
                h, off = word_hashes([a, x])
                ok.append(holds(h[: off[1]].tolist(), h[off[1] :].tolist(), run, share, stretch))
            k = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(k), b.column(1).filter(k)], names=["doc_id", "item_id"])

    return f


def leaks(docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", passage: str = "passage", run: int = 13, share: float = 0.75, stretch: float = 1.5, broadcast_chars: int = 4_000_000, salts: int = 16) -> DataFrame:
    """(doc_id, item_id): documents that hold ``run`` consecutive words of a passage, or ``share`` of its words in order within ``stretch`` times its length.

    The items go to all executors only if their passages are checked to have at most ``broadcast_chars`` characters: then one pass over the
    corpus finds and verifies, without a shuffle. Beyond that seeds of both sides are joined, a seed under ``salts`` keys so that
    boilerplate is in no single task, and only candidate texts move. Both ways use the same seeds and bounds and give the same rows, and
    neither loses any. Null, empty and blank texts and passages give nothing; a document id delivered twice gives its pairs once; repeats under other ids each count.
    """
    if run < 1 or not 0.5 < share <= 1:
        raise ValueError("need run >= 1 and 0.5 < share <= 1")
    spark = docs.sparkSession
    d = docs.select(F.col(doc).cast("long").alias("id"), F.col(text).alias("t")).where("id IS NOT NULL AND t IS NOT NULL")
    q = items.select(F.col(item).cast("long").alias("iid"), F.col(passage).alias("p")).where("iid IS NOT NULL AND p IS NOT NULL").groupBy("iid").agg(F.min("p").alias("p"))
    size = q.agg(F.coalesce(F.sum(F.length("p")), F.lit(0)).alias("c")).first()["c"]
    out = "doc_id long, item_id long"
    if size <= broadcast_chars:
        held = spark.sparkContext.broadcast(Items([(r.iid, r.p) for r in q.collect()], run, share, stretch))
        return d.mapInArrow(_scan(held, run, share, stretch), out).distinct()
    test = q.mapInArrow(_emit_items(run, share, stretch), "item long, seed long, place int, kind int, least int")
    singles = not test.where(F.col("kind") == WORD).isEmpty()
    mine = d.mapInArrow(_emit_texts(run, singles), "doc long, seed long").withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(salts)).cast("int"))
    test = test.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    places = F.countDistinct(F.when(F.col("kind") == PLACE, F.col("place")))
    near = mine.join(test, ["seed", "salt"]).groupBy("doc", "item").agg(places.alias("c"), F.max("least").alias("least"), F.max((F.col("kind") != PLACE).cast("int")).alias("sure"))
    near = near.where("sure = 1 OR c >= least").select("doc", "item")
    both = near.join(q, F.col("item") == F.col("iid")).join(d, F.col("doc") == F.col("id")).select("doc", "item", "p", "t")
    return both.mapInArrow(_check(run, share, stretch), out).distinct()
