"""Text tables of the domain as DataFrames: power curves, histograms, matrices, rates, motifs, search and report tables."""

from __future__ import annotations

from itertools import pairwise

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strandlake.operators.power import clamp_curve


def _fields(spark: SparkSession, path: str) -> DataFrame:
    d = spark.read.text(path).select(F.trim("value").alias("v")).where("v <> '' AND NOT startswith(v, '#')")
    return d.select("v", F.split("v", r"\s+").alias("f"))


def read_power(spark: SparkSession, path: str, kind: str = "single") -> DataFrame:
    """(kind, subs, prob) from two columns; probabilities are held in [0, 1]."""
    d = _fields(spark, path).where(F.size("f") >= 2).select(F.lit(kind).alias("kind"), F.col("f")[0].cast("double").alias("subs"), F.col("f")[1].cast("double").alias("prob"))
    return clamp_curve(d)


def write_table(df: DataFrame, path: str, *order: str) -> None:
    """Tab-separated text, sorted; nulls as a dash."""
    df.orderBy(*order).select(F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in df.columns)).alias("value")).write.text(path)


def read_null_histogram(spark: SparkSession, path: str) -> DataFrame:
    """(score, count, w): w is the least gap between scores, the bins' width."""
    d = _fields(spark, path).where(F.size("f") >= 2).select(F.col("f")[0].cast("double").alias("score"), F.col("f")[1].cast("long").alias("count"))
    g = F.col("score") - F.lag("score").over(W.orderBy("score"))  # a histogram is one short list
    return d.withColumn("g", F.when(g > 0, g)).withColumn("w", F.min("g").over(W.partitionBy(F.lit(1)))).drop("g")


def read_matrices(spark: SparkSession, path: str) -> DataFrame:
    """(model, name, a, b, v): every cell of the named square blocks of a file; a name line, then rows of numbers."""

    def f(it):
        for t in it:
            out = []
            for path_, text in zip(t.path, t.value):
                name, row = "", 0
                for line in text.split("\n"):
                    p = line.split()
                    if not p or line.lstrip().startswith("#"):
                        continue
                    try:
                        v = [float(x) for x in (p if len(p) > 1 and not p[0][:1].isalpha() else p[1:])]
                        if not v:
                            raise ValueError
                        out += [(path_.rsplit("/", 1)[-1], name, row, b, x) for b, x in enumerate(v)]
                        row += 1
                    except ValueError:
                        name, row = line.strip(), 0
            yield pd.DataFrame(out, columns=["model", "name", "a", "b", "v"])

    d = spark.read.text(path, wholetext=True).select("value", F.input_file_name().alias("path"))
    return d.mapInPandas(f, "model string, name string, a int, b int, v double")


def read_rates(spark: SparkSession, path: str) -> DataFrame:
    """(model, name, v) from lines of name-value pairs with the model after a bar."""
    d = spark.read.text(path).where(F.col("value").contains("|"))
    model = F.regexp_extract("value", r"model\s+(\S+)", 1)
    pairs = F.expr(r"regexp_extract_all(split_part(value, '|', 1), '([A-Za-z]\\w*)\\s+([-+0-9.eE]+)', 0)")
    return d.select(model.alias("model"), F.explode(pairs).alias("p")).select("model", F.split("p", r"\s+")[0].alias("name"), F.split("p", r"\s+")[1].cast("double").alias("v"))


def read_motifs(spark: SparkSession, path: str) -> DataFrame:
    """(kind, name, segments): structural motif descriptors HL, BL, IL, J3, J4, BS; '-' is an empty segment, '#' starts a comment."""
    d = spark.read.text(path).select(F.trim(F.regexp_replace("value", r"#.*", "")).alias("v"))
    d = d.select(F.split("v", r"\s+").alias("f")).where(F.col("f")[0].isin("HL", "BL", "IL", "J3", "J4", "BS"))
    seg = F.transform(F.slice("f", 2, F.greatest(F.size("f") - 2, F.lit(0))), lambda s: F.when(s == "-", "").otherwise(F.upper(s)))
    return d.select(F.col("f")[0].alias("kind"), F.element_at("f", -1).alias("name"), seg.alias("segments"))


def rotations(motifs: DataFrame) -> DataFrame:
    """Motifs with their rotated forms: internal loops the other way round, junctions from every branch; equal ones once."""
    turn = F.when(F.col("kind").isin("J3", "J4"), F.sequence(F.lit(0), F.size("segments") - 1)).when(F.col("kind") == "IL", F.array(F.lit(0), F.floor(F.size("segments") / 2).cast("int"))).otherwise(F.array(F.lit(0)))
    d = motifs.withColumn("k", F.explode(turn))
    rot = F.concat(F.slice("segments", F.col("k") + 1, F.size("segments")), F.slice("segments", F.lit(1), F.col("k")))
    return d.withColumn("segments", rot).groupBy("kind", "segments").agg(F.min("name").alias("name"), F.min("k").alias("turn"))


# The letters each degenerate nucleotide code stands for.
IUPAC = {"A": "A", "C": "C", "G": "G", "U": "U", "T": "U", "R": "AG", "Y": "CU", "S": "CG", "W": "AU", "K": "GU", "M": "AC", "B": "CGU", "D": "AGU", "H": "ACU", "V": "ACG", "N": "ACGU"}


def segment_pattern(segment: str) -> str:
    """Regular expression of a segment of degenerate letters."""
    return "".join(f"[{IUPAC[c]}]" if len(IUPAC.get(c, c)) > 1 else IUPAC.get(c, c) for c in segment.upper())


def scan_segments(seqs: DataFrame, segments: list[tuple[str, str]], key: str = "seq_id", text: str = "res") -> DataFrame:
    """(key, motif, pos): every place, from 1 and overlapping, at which a named segment matches; one pass for all segments."""
    found = []
    for name, seg in segments:
        ends = F.expr(f"regexp_extract_all({text}, '(?=({segment_pattern(seg)}))', 1)")
        found.append(F.struct(F.lit(name).alias("motif"), F.size(ends).alias("n"), F.lit(segment_pattern(seg)).alias("pat")))
    d = seqs.select(key, text, F.explode(F.array(*found)).alias("m")).where("m.n > 0")
    places = F.expr(f"filter(sequence(1, length({text})), p -> substring({text}, p) rlike concat('^', m.pat))")
    return d.select(key, "m.motif", F.explode(places).alias("pos"))


def read_domains(spark: SparkSession, path: str) -> DataFrame:
    """(target, query, evalue, score, hmm_from, hmm_to, ali_from, ali_to) of a per-domain search table; comment lines are skipped."""
    f = F.col("f")
    d = _fields(spark, path).where(F.size("f") >= 22)
    return d.select(f[0].alias("target"), f[3].alias("query"), f[12].cast("double").alias("evalue"), f[13].cast("double").alias("score"), *(f[k].cast("int").alias(n) for k, n in ((15, "hmm_from"), (16, "hmm_to"), (17, "ali_from"), (18, "ali_to"))))


def write_hits(hits: DataFrame, path: str) -> None:
    """A report of (aln_id, mark, left_pos, right_pos, score, evalue), sorted: a line names the alignment, its pairs follow by falling score, equal ones by position."""
    head = hits.select("aln_id").distinct().select("aln_id", F.lit(0).alias("o"), F.lit(None).cast("double").alias("score"), F.lit(0).alias("left_pos"), F.lit(0).alias("right_pos"), F.concat(F.lit("# MSA "), "aln_id").alias("value"))
    line = F.concat_ws("\t", "mark", F.col("left_pos").cast("string"), F.col("right_pos").cast("string"), F.col("score").cast("string"), F.col("evalue").cast("string"))
    body = hits.select("aln_id", F.lit(1).alias("o"), "score", "left_pos", "right_pos", line.alias("value"))
    # one alignment's lines stay together in one file, as the reader expects; the range is by alignment alone
    d = head.unionByName(body).repartitionByRange("aln_id").sortWithinPartitions("aln_id", "o", F.desc("score"), "left_pos", "right_pos")
    d.select("value").write.text(path)


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    """Significant-pair reports: (family, mark, left_pos, right_pos, score, evalue), the family taken from the comment line above."""
    d = spark.read.text(path).withColumn("n", F.monotonically_increasing_id()).withColumn("file", F.input_file_name())
    fam = F.when(F.col("value").rlike(r"^#\s*MSA\s"), F.regexp_extract("value", r"^#\s*MSA\s+(\S+)", 1))
    d = d.withColumn("family", F.last(fam, True).over(W.partitionBy("file").orderBy("n")))
    line = r"^\s*(\*{1,2}|c?~?)\s*(\d+)\s+(\d+)\s+([-+0-9.eE]+)\s+([-+0-9.eE]+)"
    d = d.where(~F.col("value").startswith("#") & F.col("value").rlike(line))
    g = lambda k: F.regexp_extract("value", line, k)
    return d.select("family", g(1).alias("mark"), g(2).cast("int").alias("left_pos"), g(3).cast("int").alias("right_pos"), g(4).cast("double").alias("score"), g(5).cast("double").alias("evalue"))


def monotone(values: list[float]) -> bool:
    return all(a <= b for a, b in pairwise(values))
