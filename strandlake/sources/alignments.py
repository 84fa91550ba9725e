"""Alignment and sequence files as tables, and back.

Records are split by the reader's line separator, so a file of many alignments or sequences is read in
parallel pieces; only a single record is ever held whole.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEQS = "aln_id string, seq_idx int, sqname string, aseq string, wgt double, ss string"
COLS = "aln_id string, ss_cons string, rf string, seq_cons string"


def _parse(record: str, number: int) -> dict | None:
    """One Stockholm record: names in order of first sight, wrapped blocks joined; '=' and '.' stay as gaps."""
    name, seqs, wgt, gr, gc = None, {}, {}, {}, {}
    for line in record.split("\n"):
        line = line.rstrip("\r")
        if not line.strip():
            continue
        if line.startswith("#=GF"):
            p = line.split(None, 2)
            if len(p) == 3 and p[1] == "ID":
                name = p[2].strip()
        elif line.startswith("#=GS"):
            p = line.split(None, 3)
            if len(p) == 4 and p[2] == "WT":
                wgt[p[1]] = float(p[3])
        elif line.startswith("#=GR"):
            p = line.split(None, 3)
            if len(p) == 4 and p[2] == "SS":
                gr[p[1]] = gr.get(p[1], "") + p[3].strip()
        elif line.startswith("#=GC"):
            p = line.split(None, 2)
            if len(p) == 3:
                gc[p[1]] = gc.get(p[1], "") + p[2].strip()
        elif not line.startswith("#") and line.strip() != "//":
            p = line.split()
            if len(p) == 2:
                seqs[p[0]] = seqs.get(p[0], "") + p[1].replace("=", ".")
    return {"id": name or f"msa{number}", "seqs": seqs, "wgt": wgt, "gr": gr, "gc": gc} if seqs or gc else None


def _records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n//\n").text(path).withColumn("n", F.monotonically_increasing_id())


def read_stockholm(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(seqs, columns): aligned rows with weights and own structures, and each alignment's annotation."""

    def seqs(it):
        for t in it:
            rows = [(r["id"], k, s, a, r["wgt"].get(s), r["gr"].get(s)) for v, n in zip(t.value, t.n) if (r := _parse(v, n)) for k, (s, a) in enumerate(r["seqs"].items())]
            yield pd.DataFrame(rows, columns=["aln_id", "seq_idx", "sqname", "aseq", "wgt", "ss"])

    def cols(it):
        for t in it:
            rows = [(r["id"], r["gc"].get("SS_cons"), r["gc"].get("RF"), r["gc"].get("seq_cons")) for v, n in zip(t.value, t.n) if (r := _parse(v, n))]
            yield pd.DataFrame(rows, columns=["aln_id", "ss_cons", "rf", "seq_cons"])

    d = _records(spark, path)
    return d.mapInPandas(seqs, SEQS), d.mapInPandas(cols, COLS)


def write_stockholm(seqs: DataFrame, columns: DataFrame, path: str) -> None:
    """One record for each alignment. Names lose blanks; rows without a string are left out."""
    name = F.regexp_replace(F.coalesce("sqname", F.lit("seq")), r"\s+", "_")
    row = F.struct("seq_idx", F.concat(F.format_string("%s.%d", name, "seq_idx"), F.lit(" "), "aseq").alias("t"))
    body = seqs.where(F.length("aseq") > 0).groupBy("aln_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["t"]), "\n").alias("body"))
    d = body.join(columns, "aln_id", "left")
    ss = F.when(F.col("ss_cons").isNotNull(), F.concat(F.lit("\n#=GC SS_cons "), "ss_cons")).otherwise("")
    d.select(F.concat(F.lit("# STOCKHOLM 1.0\n#=GF ID "), "aln_id", F.lit("\n"), "body", ss).alias("value")).write.option("lineSep", "\n//\n").text(path)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, descr, seq) of plain or aligned FASTA, wrapped or not; empty records are dropped."""
    d = spark.read.option("lineSep", "\n>").text(path)
    head, body = F.regexp_extract("value", r"^>?([^\n]*)", 1), F.regexp_extract("value", r"^[^\n]*\n([\s\S]*)$", 1)
    d = d.where(F.trim("value") != "").select(head.alias("h"), F.regexp_replace(body, r"\s+", "").alias("seq"))
    return d.select(F.regexp_extract("h", r"^\s*(\S*)", 1).alias("name"), F.regexp_extract("h", r"^\s*\S+\s+(.*?)\s*$", 1).alias("descr"), "seq")


def write_fasta(seqs: DataFrame, path: str, name: str = "name", seq: str = "seq", wrap: int = 60) -> None:
    """Wrapped FASTA; null sequences are left out."""
    lines = F.regexp_replace(F.col(seq), f"(.{{{wrap}}})(?=.)", "$1\n")
    seqs.where(F.col(seq).isNotNull()).select(F.concat(F.lit(">"), F.col(name), F.lit("\n"), lines).alias("value")).write.text(path)


def one_hot(seqs: DataFrame, seq: str = "seq") -> DataFrame:
    """seqs with ``profile``: for each letter the probabilities of A, C, G, U; R and Y are halves, other degenerate letters quarters."""
    p = lambda *v: F.array(*map(F.lit, map(float, v)))
    letter = lambda c: F.when(c == "A", p(1, 0, 0, 0)).when(c == "C", p(0, 1, 0, 0)).when(c == "G", p(0, 0, 1, 0)).when(c.isin("U", "T"), p(0, 0, 0, 1)).when(c == "R", p(0.5, 0, 0.5, 0)).when(c == "Y", p(0, 0.5, 0, 0.5)).otherwise(p(0.25, 0.25, 0.25, 0.25))
    chars = F.filter(F.split(F.upper(seq), ""), lambda c: c != "")
    return seqs.withColumn("profile", F.transform(chars, letter))


_NEWICK = re.compile(r"\s*([(),;]|'[^']*'|[^\s(),;:]+)?\s*(?::\s*([-+0-9.eE]+))?")


def parse_newick(text: str) -> list[tuple[int, int, str | None, float]]:
    """(parent, child, leaf name, branch length) of a Newick tree; node 0 is the root, a missing length is 0."""
    edges, stack, n, last = [], [], 0, None
    length: dict[int, float] = {}
    name: dict[int, str] = {}
    parent: dict[int, int] = {}
    kids: set[int] = set()
    pos = 0

    def node():
        nonlocal n
        n += 1
        return n - 1

    while pos < len(text):
        m = _NEWICK.match(text, pos)
        if not m or m.end() == pos:
            break
        tok, dist = m.group(1), m.group(2)
        pos = m.end()
        if tok == "(":
            k = node()
            if stack:
                parent[k] = stack[-1]
            kids.add(k)
            stack.append(k)
            last = None
        elif tok == ",":
            last = None
        elif tok == ")":
            last = stack.pop()
        elif tok == ";":
            break
        elif tok:
            if last is None:
                last = node()
                if stack:
                    parent[last] = stack[-1]
            name[last] = tok.strip("'")
        if dist and last is not None:
            length[last] = float(dist)
    for c, p in sorted(parent.items()):
        edges.append((p, c, None if c in kids else name.get(c), length.get(c, 0.0)))
    return edges


def read_newick(spark: SparkSession, path: str) -> DataFrame:
    """(tree, parent, child, is_leaf, name, blen): all trees of a file, one record up to each semicolon."""

    def f(it):
        for t in it:
            rows = [(int(n), p, c, name is not None, name, b) for v, n in zip(t.value, t.n) for p, c, name, b in parse_newick(v + ";")]
            yield pd.DataFrame(rows, columns=["tree", "parent", "child", "is_leaf", "name", "blen"])

    d = spark.read.option("lineSep", ";").text(path).where(F.trim("value") != "").withColumn("n", F.monotonically_increasing_id())
    return d.mapInPandas(f, "tree long, parent int, child int, is_leaf boolean, name string, blen double")
