"""Cutting oversized aligned rows at natural boundaries by packing a structure tree.

A row is parsed into a tree. Gap stretches are its markup: the longer a stretch, the higher the level that it parts, so that
the stretches of ``LEVELS[0]`` symbols part chapters, shorter ones sections in a chapter, and the shortest the segments in a section.
Bottom-up, small siblings merge into one subtree while they fit the limit together. A piece then takes whole subtrees and descends only into one that doesn't fit.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A stretch of at least three gap or missing symbols, up to a letter.
_STRETCH = re.compile(r"[-._~]{3,}(?=[^\W\d_])")
#: Least symbols of a stretch that parts subtrees, from the top of the tree down.
LEVELS = (48, 12, 3)


@dataclass(slots=True)
class Node:
    """Columns start+1..end of a row; a leaf has no children."""

    start: int
    end: int
    kids: list[Node] = field(default_factory=list)
    merged: bool = False  # siblings joined bottom-up, not a unit of the text


def parse(aseq: str, levels: tuple[int, ...] = LEVELS) -> Node:
    """The tree of a row: below the root one level for each of ``levels``, parted where a stretch is at least so long."""
    stops = [(m.end(), m.end() - m.start()) for m in _STRETCH.finditer(aseq)]

    def grow(start: int, end: int, inside: list[tuple[int, int]], depth: int) -> Node:
        node = Node(start, end)
        while depth < len(levels) and not any(n >= levels[depth] for _, n in inside):
            depth += 1  # a level that parts nothing has no node of its own
        if depth < len(levels) and inside:
            at, part = start, []
            for stop, n in [*inside, (end, levels[0])]:
                if n >= levels[depth]:
                    node.kids.append(grow(at, stop, part, depth + 1))
                    at, part = stop, []
                else:
                    part.append((stop, n))
        return node

    return grow(0, len(aseq), [s for s in stops if s[0] < len(aseq)], 0)


def merge(node: Node, limit: int) -> Node:
    """The tree with sibling subtrees merged bottom-up, pair by pair from the left, while both fit ``limit`` together."""
    kids = [merge(k, limit) for k in node.kids]
    while len(kids) > 2:
        out, k = [], 0
        while k < len(kids):
            if k + 1 < len(kids) and kids[k + 1].end - kids[k].start <= limit:
                out.append(Node(kids[k].start, kids[k + 1].end, [kids[k], kids[k + 1]], True))
                k += 2
            else:
                out.append(kids[k])
                k += 1
        if len(out) == len(kids):
            break
        kids = out
    return Node(node.start, node.end, kids, node.merged)


def _last_end(node: Node, top: int) -> int:
    """End of the last subtree that ends at or before column ``top``: whole ones are taken, only the one across ``top`` is entered."""
    got = 0
    while node.kids:
        k = bisect_right(node.kids, top, key=lambda x: x.end)
        if k:
            got = max(got, node.kids[k - 1].end)
        if k == len(node.kids):
            break
        node = node.kids[k]
    return got


def _highest_end(node: Node, low: int, top: int) -> int:
    """End, in low..top, of the last subtree of the highest level that has one there; merged subtrees are no level."""
    layer = [node]
    while layer:
        ends = [k.end for n in layer for k in n.kids if not k.merged and low <= k.end <= top]
        if ends:
            return max(ends)
        layer = [k for n in layer for k in n.kids[bisect_right(n.kids, low, key=lambda x: x.end) :] if k.start < top]
    return 0


def pack(aseq: str, limit: int = 400, overlap: int = 40, least: int = 200, by_level: bool = False) -> list[tuple[int, int]]:
    """(start, end) of the pieces of a row; columns from 1, ends inclusive.

    A piece from s takes subtrees up to column s+limit-1, as many as fit; with ``by_level`` it ends where the highest level ends
    that does so from s+least on, so that a chapter's end comes before a later end of a segment. If none ends at s+least or later it is cut
    at s+limit-1. The next piece starts overlap-1 columns before that end. A row within the limit is one piece.
    """
    n, out, s = len(aseq), [], 1
    tree = merge(parse(aseq), limit) if n > limit else Node(0, n)
    while True:
        top = s + limit - 1
        if n <= top:
            out.append((s, n))
            return out
        end = _highest_end(tree, s + least, top) if by_level else _last_end(tree, top)
        if end < s + least:
            end = top
        out.append((s, end))
        s = end - overlap + 1


def split_rows(rows: DataFrame, key: str, text: str, limit: int = 400, overlap: int = 40, least: int = 200, by_level: bool = False) -> DataFrame:
    """(key, piece_no, start_col, end_col) of every row longer than ``limit`` characters.

    Rows that are null or within the limit give nothing; a key delivered twice gives its pieces once. Lengths
    are those of the text, whatever other columns say. Only long rows reach Python, and only their pieces are shuffled.
    """
    if not 0 < overlap < least <= limit:
        raise ValueError("need 0 < overlap < least <= limit")

    def run(batches):
        for b in batches:
            cut = [pack(x, limit, overlap, least, by_level) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([[e for p in c for e in p] for c in cut], pa.list_(pa.int32()))], names=["k", "ends"])

    long_ = rows.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).where(F.col("k").isNotNull() & (F.length("t") > limit))
    pieces = long_.mapInArrow(run, "k long, ends array<int>").groupBy("k").agg(F.min("ends").alias("ends"))
    at = F.posexplode(F.expr("transform(sequence(0, cast(size(ends)/2 as int) - 1), i -> struct(ends[2*i] as s, ends[2*i+1] as e))")).alias("i", "p")
    return pieces.select("k", at).select(F.col("k").alias(key), (F.col("i") + 1).alias("piece_no"), F.col("p.s").alias("start_col"), F.col("p.e").alias("end_col"))


def rejoin(aseq: str, pieces: list[tuple[int, int]]) -> str:
    """The row again from its pieces, for round trips."""
    out, upto = [], 0
    for s, e in pieces:
        out.append(aseq[max(s - 1, upto) : e])
        upto = e
    return "".join(out)
