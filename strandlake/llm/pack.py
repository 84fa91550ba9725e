"""Filling fixed-capacity containers: best-fit decreasing in partitions, certified by dual-feasible functions.

A lower bound from dual-feasible functions tells for each partition how many containers it needs at
least. A partition that meets its bound is done. Of the others the containers with space left are
opened, their documents exchanged between partitions, and packed again.
"""

from __future__ import annotations

import os
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.storage import materialize

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container of each item, items taken by falling size, each into the fullest container that takes it.

    A set of bits holds which free spaces exist, so a placement costs a few operations on an integer.
    """
    order = np.argsort(-sizes, kind="stable")
    out = np.zeros(len(sizes), np.int64)
    free: dict[int, list[int]] = defaultdict(list)
    spaces, n = 0, 0
    for i in order.tolist():
        s = int(sizes[i])
        fit = spaces >> s
        if fit:
            room = s + ((fit & -fit).bit_length() - 1)
            at = free[room].pop()
            if not free[room]:
                spaces &= ~(1 << room)
        else:
            room, at, n = capacity, n, n + 1
        out[i] = at
        left = room - s
        free[left].append(at)
        spaces |= 1 << left
    return out


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Fewest containers any packing needs, by the classic dual-feasible functions over all their useful parameters.

    u_k rounds x*(k+1)/C to a multiple of 1/k unless it is whole; U_e counts items above C-e as full and drops those below e.
    The plain volume bound is u with k without end.
    """
    if not len(sizes):
        return 0
    v, n = np.unique(sizes, return_counts=True)
    best = -(-int((v * n).sum()) // capacity)
    for k in range(1, 21):
        m = v * (k + 1)
        whole = m % capacity == 0
        w = np.where(whole, v * k, (m // capacity) * capacity)  # scaled by k * capacity
        best = max(best, -(-int((w * n).sum()) // (k * capacity)))
    v2 = v[v <= capacity // 2]
    total, count = np.cumsum(v * n), np.cumsum(n)
    for e in np.unique(np.concatenate([[1], v2, v2 + 1])).tolist():
        if e > capacity // 2:
            continue
        lo, hi = np.searchsorted(v, e, "left"), np.searchsorted(v, capacity - e, "right")  # hi: sizes above C-e
        full = int(count[-1] - (count[hi - 1] if hi else 0))
        mid = int((total[hi - 1] if hi else 0) - (total[lo - 1] if lo else 0)) if hi > lo else 0
        best = max(best, full + -(-mid // capacity))
    return best


def _count(vocabulary):
    def run(batches):
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(vocabulary.value)
        t.encode_special_tokens = True
        for b in batches:
            texts, n = b.column(1).to_pylist(), []
            chunk, held = [], 0
            for x in [*texts, None]:
                if chunk and (x is None or held > 400_000):
                    n += [len(e.ids) for e in t.encode_batch_fast(chunk, add_special_tokens=False)]
                    chunk, held = [], 0
                if x is not None:
                    chunk.append(x)
                    held += len(x)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["doc_id", "tokens"])

    return run


def token_counts(docs: DataFrame, doc: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, tokens): whole texts in tokens of a public tokenizer; a null text has none.

    ``tokenizer`` is a vocabulary file that the driver can read, of at most 64 MB; executors get its content, not its path.
    """
    if os.path.getsize(tokenizer) > 64 << 20:
        raise ValueError("the vocabulary file is larger than 64 MB")
    with open(tokenizer, encoding="utf-8") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())
    d = docs.select(F.col(doc).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t")).where("doc_id IS NOT NULL")
    return d.mapInArrow(_count(vocabulary), "doc_id long, tokens long").groupBy("doc_id").agg(F.min("tokens").alias("tokens"))


def _packer(r: int, capacity: int, full: float):
    def pack(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(["doc_id", "piece_no"], ignore_index=True)
        size = t.tokens.to_numpy()
        box = best_fit(size, capacity)
        load = np.bincount(box, size)
        gap = int(box.max()) + 1 - lower_bound(size, capacity)
        # only where the bound leaves a gap, and only containers with space, are opened again
        open_ = (load < full * capacity)[box] & (gap > 0)
        return t.assign(container_id=[f"{r}-{p}-{x}" for p, x in zip(t.part, box)], open=open_)[["doc_id", "piece_no", "n_pieces", "start_token", "tokens", "container_id", "open"]]

    return pack


def assign(sizes: DataFrame, capacity: int = 2048, part_items: int = 20_000, rounds: int = 4, full: float = 0.995) -> DataFrame:
    """(doc_id, piece_no, n_pieces, start_token, tokens, container_id) for items (doc_id, tokens).

    An item larger than ``capacity`` is cut into pieces of the capacity and a rest; no other is cut. An item
    of no tokens gets one row and container NULL. Every other row is in one container, and no container holds more
    than ``capacity``. After ``rounds`` exchanges the packing stands as it is; ``certificates`` tells how far from the bound.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    s = sizes.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("tokens"), F.lit(0)).cast("long").alias("n")).where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("n").alias("n"))
    s = s.withColumn("n_pieces", F.greatest(F.lit(1), F.ceil(F.col("n") / capacity)).cast("int"))
    items = s.select("doc_id", "n", "n_pieces", F.explode(F.sequence(F.lit(1), F.col("n_pieces"))).alias("piece_no"))
    items = materialize(items.select("doc_id", "piece_no", "n_pieces", ((F.col("piece_no") - 1).cast("long") * capacity).alias("start_token"), F.least(F.lit(capacity), F.col("n") - (F.col("piece_no") - 1).cast("long") * capacity).cast("int").alias("tokens")), "items")
    cols = "doc_id long, piece_no int, n_pieces int, start_token long, tokens int"
    empty = items.where("tokens <= 0").select("*", F.lit(None).cast("string").alias("container_id"))
    whole = items.where(F.col("tokens") == capacity).select("*", F.concat(F.lit("full-"), "doc_id", F.lit("-"), "piece_no").alias("container_id"))
    done, left = [empty, whole], items.where((F.col("tokens") > 0) & (F.col("tokens") < capacity))

    for r in range(rounds + 1):
        count = left.count()
        if not count:
            break
        parts = max(1, -(-count // part_items))

        dealt = left.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece_no", F.lit(r)), F.lit(parts)).cast("int"))
        packed = materialize(dealt.groupBy("part").applyInPandas(_packer(r, capacity, full), cols + ", container_id string, open boolean"), "packed")
        if r == rounds or parts == 1:
            done.append(packed.drop("open"))  # nobody to exchange with, or no rounds left
            break
        done.append(packed.where("NOT open").drop("open"))
        left = packed.where("open").drop("open", "container_id")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def certificates(assigned: DataFrame, capacity: int = 2048, part_items: int = 20_000) -> DataFrame:
    """(part, containers, bound, tokens): containers used next to a certified bound, for parts of whole containers.

    The bound of a part holds for its items however they are packed.
    """
    a = assigned.where("container_id IS NOT NULL")
    parts = max(1, -(-a.count() // part_items))

    def f(t: pd.DataFrame) -> pd.DataFrame:
        size = t.tokens.to_numpy()
        return pd.DataFrame({"part": [t.part[0]], "containers": [t.container_id.nunique()], "bound": [lower_bound(size, capacity)], "tokens": [int(size.sum())]})

    return a.select("tokens", "container_id", F.pmod(F.xxhash64("container_id"), F.lit(parts)).cast("int").alias("part")).groupBy("part").applyInPandas(f, "part int, containers long, bound long, tokens long")
