"""Subjects of documents: one-versus-rest linear classifiers on hashed word n-grams of sentences.

Weak labels come from the labels by hand, from address paths (source) and from section metadata (title,
family) that name a subject. A document's label is passed to its sentences, and after each round of training a
sentence keeps only the labels its own words speak for, so that filler sentences lose theirs.
Thresholds are calibrated per subject on documents held out from training.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strandlake.llm.text import sentences, word_hashes

BITS = 17
_B = np.uint64(0x9E3779B97F4A7C15)


class Features:
    """Hashed word uni- and bigrams of sentences; numbers fold to one token."""

    def __init__(self, bits: int = BITS):
        self.shift = np.uint64(64 - bits)

    def __call__(self, sents: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Feature numbers of all sentences one after the other, and the offset of each sentence."""
        h, start = word_hashes(sents, numbers_alike=True)
        n = np.diff(start)
        uni = (h * _B) >> self.shift
        pair = np.zeros(len(h), np.uint64)
        if len(h) > 1:
            pair[:-1] = ((h[:-1] * np.uint64(31) + h[1:]) * _B) >> self.shift
        last = np.zeros(len(h), bool)
        last[start[1:][n > 0] - 1] = True
        out = np.empty(2 * len(h), np.int64)
        out[0::2], out[1::2] = uni, np.where(last, uni, pair)  # the last word has no bigram: it counts twice
        return out, 2 * start


def scores(weights: np.ndarray, bias: np.ndarray, feats: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Log-odds of every sentence for every subject."""
    n = np.diff(off)
    out = np.zeros((len(n), weights.shape[1]), np.float32)
    some = np.flatnonzero(n)
    if len(some):
        out[some] = np.add.reduceat(weights[feats], off[:-1][some], axis=0) / np.sqrt(n[some])[:, None]
    return out + bias


@dataclass
class Model:
    subjects: list[str]
    weights: np.ndarray
    bias: np.ndarray
    cut: np.ndarray  # log-odds from which a sentence is about a subject
    share: np.ndarray  # share of sentences from which a document is

    def document_share(self, feats: np.ndarray, off: np.ndarray) -> np.ndarray:
        s = scores(self.weights, self.bias, feats, off)
        return (s >= self.cut).mean(0) if len(s) else np.zeros(len(self.subjects))


def _fit(feats, off, y, dims, epochs, rng, rate=0.5, l2=1e-6):
    """Logistic regressions for all subjects at once by AdaGrad on shuffled batches of sentences."""
    w, b = np.zeros((dims, y.shape[1]), np.float32), np.full(y.shape[1], -2.0, np.float32)
    g2, gb = np.full(dims, 1e-3, np.float32), 1e-3
    n = np.diff(off)
    ok = np.flatnonzero(n)
    for _ in range(epochs):
        order = rng.permutation(ok)
        for at in range(0, len(order), 256):
            sel = order[at : at + 256]
            length = n[sel]
            o = np.concatenate([[0], np.cumsum(length)])
            idx = np.repeat(off[sel] - o[:-1], length) + np.arange(o[-1])
            f = feats[idx]
            scale = 1 / np.sqrt(length)
            z = np.add.reduceat(w[f], o[:-1], axis=0) * scale[:, None] + b
            d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[sel]).astype(np.float32)
            uf, inv = np.unique(f, return_inverse=True)
            grad = np.zeros((len(uf), y.shape[1]), np.float32)
            np.add.at(grad, inv, np.repeat(d * scale[:, None], length, axis=0))
            grad = grad / 16 + l2 * w[uf]
            g2[uf] += (grad**2).mean(1)
            w[uf] -= rate * grad / np.sqrt(g2[uf])[:, None]
            gb += float((d.mean(0) ** 2).mean())
            b -= 0.1 * d.mean(0) / np.sqrt(gb)
    return w, b


def train(docs: list[tuple[list[str], set[str]]], subjects: list[str], bits: int = BITS, rounds: int = 3, epochs: int = 4, share: float = 0.25, seed: int = 7) -> Model:
    """A model from (sentences, labels) of labelled documents; a fifth is held out to calibrate thresholds."""
    rng = np.random.default_rng(seed)
    feats = Features(bits)
    sents = [s for d, _ in docs for s in d]
    f, off = feats(sents)
    doc = np.repeat(np.arange(len(docs)), [len(d) for d, _ in docs])
    lab = np.array([[s in y for s in subjects] for _, y in docs], np.float32).reshape(len(docs), len(subjects))
    held = rng.random(len(docs)) < 0.2
    y = lab[doc].copy()
    use = ~held[doc]
    w, b = np.zeros((1 << bits, len(subjects)), np.float32), np.zeros(len(subjects), np.float32)
    k = np.flatnonzero(use)
    for r in range(rounds):
        length = np.diff(off)
        o = np.concatenate([[0], np.cumsum(length[k])]).astype(np.int64)
        idx = np.repeat(off[k] - o[:-1], length[k]) + np.arange(o[-1])
        w, b = _fit(f[idx], o, y[k], 1 << bits, epochs, rng)
        if r < rounds - 1:
            # a sentence keeps its document's label only where it speaks for it more than for the others
            z = scores(w, b, f, off)
            p = 1 / (1 + np.exp(-z))
            top = (p * lab[doc]).max(1, keepdims=True)
            y = ((lab[doc] > 0) & (p >= 0.4) & (p >= 0.6 * top)).astype(np.float32)
    z = scores(w, b, f, off)
    cut, shares = np.zeros(len(subjects), np.float32), np.full(len(subjects), share, np.float32)
    for s in range(len(subjects)):
        best = (-1.0, 0.0, share)
        for c in np.arange(-1.5, 2.01, 0.25):
            got = np.bincount(doc, z[:, s] >= c, len(docs)) / np.maximum(np.bincount(doc, minlength=len(docs)), 1)
            for t in (share, 0.85 * share, 0.7 * share):
                pred, true = (got >= t)[held], lab[held, s] > 0
                f1 = 2 * (pred & true).sum() / max(1, pred.sum() + true.sum())
                best = max(best, (float(f1) - 0.02 * abs(c) - 0.02 * (share - t) / share, float(c), float(t)))
        cut[s], shares[s] = best[1], best[2]
    return Model(subjects, w, b, cut, shares)


def weak_labels(docs: DataFrame, labels: DataFrame, subjects: DataFrame, least_docs: int = 5, least_share: float = 0.8) -> DataFrame:
    """(doc_id, subject): labels by hand, and subjects that a document's address path or section metadata name or imply.

    Labels are trimmed and lowered, unknown and null ones dropped. A path or title names a subject if a whole word of it is the subject; it
    implies one if a word of it stands on at least ``least_docs`` documents labelled by hand, of which at least ``least_share`` have that subject.
    """
    known = subjects.select(F.lower(F.trim("subject")).alias("subject")).where("subject <> ''").distinct()
    hand = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.trim("subject")).alias("subject")).join(known, "subject", "left_semi").select("doc_id", "subject").distinct()
    word = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(F.array_distinct(F.split(F.lower(F.concat_ws(" ", "source", "title", "aln_name")), "[^a-z]+"))).alias("word")).where("word <> ''")
    seen = word.join(hand.select("doc_id").distinct(), "doc_id", "left_semi").distinct()
    all_ = seen.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_docs)
    implied = seen.join(hand, "doc_id").groupBy("word", "subject").agg(F.count(F.lit(1)).alias("k")).join(all_, "word").where(F.col("k") >= least_share * F.col("n")).select("word", "subject")
    rules = known.withColumn("word", F.col("subject")).select("word", "subject").unionByName(implied).distinct()
    return hand.unionByName(word.join(rules, "word").select("doc_id", "subject")).where("doc_id IS NOT NULL").distinct()


def train_on(docs: DataFrame, labels: DataFrame, subjects: DataFrame, per_language: int = 1500, max_sentences: int = 60) -> Model:
    """A model from at most ``per_language`` labelled documents of each language spelling's first two letters.

    The documents are those whose id hashes lowest, so the sample is the same on every run, and at most 8 languages times ``per_language`` come to the driver, in whole sentences,
    of each document ``max_sentences`` at even distances. Only training is bounded; every document is classified whole.
    """
    names = sorted({r.s for r in subjects.select(F.lower(F.trim("subject")).alias("s")).where("s <> ''").distinct().limit(1001).collect()})
    if len(names) > 1000:
        raise ValueError("the model holds one column of weights for each subject: at most 1000")
    lab = weak_labels(docs, labels, subjects).groupBy("doc_id").agg(F.collect_set("subject").alias("subjects"))
    lang = F.lower(F.substring(F.trim(F.coalesce("lang", F.lit(""))), 1, 2))
    bucket = F.when(lang.isin("en", "de", "fr", "es"), lang).otherwise(F.lit("other"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), bucket.alias("lang")).join(lab, "doc_id")
    ids = ids.withColumn("h", F.xxhash64("doc_id")).withColumn("salt", F.pmod("h", F.lit(64)))
    for part in (("lang", "salt"), ("lang",)):  # the lowest of each salt first, so that no task sorts a whole language
        w = W.partitionBy(*part).orderBy("h", "doc_id")
        ids = ids.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= per_language)
    ids = ids.select("doc_id", "subjects")

    def cut(batches):
        for b in batches:
            out = []
            for t in b.column(0).to_pylist():
                s = sentences(t)
                if len(s) > max_sentences:
                    s = [s[i * len(s) // max_sentences] for i in range(max_sentences)]
                out.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.string())), b.column(1)], names=["s", "y"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL").join(ids, "doc_id").select("text", "subjects").mapInArrow(cut, "s array<string>, y array<string>")
    got = sorted(((tuple(r.s), tuple(sorted(r.y))) for r in rows.toLocalIterator()), key=str)
    return train([(list(s), set(y)) for s, y in got if s], names)


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, subject, share): every subject that enough of a document's sentences are about.

    The whole text counts. A null, empty or sentence-less text has no subjects; an id delivered twice counts once.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m, feats = held.value, Features(int(np.log2(len(held.value.weights))))
        for b in batches:
            doc, sub, share = [], [], []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                s = sentences(t)
                if not s:
                    continue
                part = np.zeros(len(m.subjects))
                for at in range(0, len(s), 5000):  # very long texts in pieces of bounded memory
                    piece = s[at : at + 5000]
                    part += m.document_share(*feats(piece)) * len(piece)
                part /= len(s)
                for j in np.flatnonzero(part >= m.share - 1e-9):
                    doc.append(d)
                    sub.append(m.subjects[j])
                    share.append(float(part[j]))
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(sub, pa.string()), pa.array(share, pa.float64())], names=["doc_id", "subject", "share"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    return d.mapInArrow(run, "doc_id long, subject string, share double").groupBy("doc_id", "subject").agg(F.max("share").alias("share"))
