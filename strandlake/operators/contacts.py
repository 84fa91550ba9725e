"""Contacts of residues: from coordinates by a grid join, from pairing tables, and their labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def from_atoms(atoms: DataFrame, max_d: float, min_sep: int = 3) -> DataFrame:
    """(aln_id, i, j, dist): residue pairs of a chain with j - i + 1 > min_sep and a least atom distance below max_d.

    atoms: (aln_id, resnum, x, y, z). The theta join becomes an equi-join on grid cells of edge max_d: an atom is
    put into its cell and, on one side, into the 27 cells around, so only near atoms meet. Null coordinates take no part.
    """
    ok = atoms.where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL AND resnum IS NOT NULL")
    cell = lambda c: F.floor(F.col(c) / max_d).cast("long")
    a = ok.select("aln_id", F.col("resnum").alias("i"), *(F.col(c).alias(f"{c}1") for c in "xyz"), *(cell(c).alias(f"g{c}") for c in "xyz"))
    b = ok.select("aln_id", F.col("resnum").alias("j"), *(F.col(c).alias(f"{c}2") for c in "xyz"), *(cell(c).alias(f"h{c}") for c in "xyz"))
    for c in "xyz":
        b = b.withColumn(f"g{c}", F.explode(F.sequence(F.col(f"h{c}") - 1, F.col(f"h{c}") + 1)))
    d = F.sqrt(sum(((F.col(f"{c}1") - F.col(f"{c}2")) ** 2 for c in "xyz"), F.lit(0.0)))
    near = a.join(b, ["aln_id", "gx", "gy", "gz"]).where(F.col("j") - F.col("i") + 1 > min_sep).withColumn("d", d).where(F.col("d") < max_d)
    return near.groupBy("aln_id", "i", "j").agg(F.min("d").alias("dist"))


def between_chains(atoms: DataFrame, max_d: float) -> DataFrame:
    """(chain_a, i, chain_b, j, dist): residues of different chains, chain_a the lesser, with a least atom distance below max_d; the same grid join.

    atoms: (chain, resnum, x, y, z).
    """
    ok = atoms.where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL AND resnum IS NOT NULL AND chain IS NOT NULL")
    cell = lambda c: F.floor(F.col(c) / max_d).cast("long")
    a = ok.select(F.col("chain").alias("chain_a"), F.col("resnum").alias("i"), *(F.col(c).alias(f"{c}1") for c in "xyz"), *(cell(c).alias(f"g{c}") for c in "xyz"))
    b = ok.select(F.col("chain").alias("chain_b"), F.col("resnum").alias("j"), *(F.col(c).alias(f"{c}2") for c in "xyz"), *(cell(c).alias(f"h{c}") for c in "xyz"))
    for c in "xyz":
        b = b.withColumn(f"g{c}", F.explode(F.sequence(F.col(f"h{c}") - 1, F.col(f"h{c}") + 1)))
    d = F.sqrt(sum(((F.col(f"{c}1") - F.col(f"{c}2")) ** 2 for c in "xyz"), F.lit(0.0)))
    near = a.join(b, ["gx", "gy", "gz"]).where("chain_a < chain_b").withColumn("d", d).where(F.col("d") < max_d)
    return near.groupBy("chain_a", "i", "chain_b", "j").agg(F.min("d").alias("dist"))


def from_pairs(ct: DataFrame, mind: int = 1) -> DataFrame:
    """(aln_id, i, j, cttype, ispk): pairs at least ``mind`` apart as contacts, once each; layers after the nested one are pseudoknots."""
    d = ct.where(F.col("j") - F.col("i") >= mind)
    return d.groupBy("aln_id", "i", "j").agg(F.lit("WWc").alias("cttype"), (F.min((F.col("layer") == "nested").cast("int") * -1) == 0).alias("ispk"))


def first_wins(*lists: DataFrame) -> DataFrame:
    """Union of contact lists (aln_id, i, j, cttype, ...); a pair in several keeps its first list's row."""
    out = None
    for n, c in enumerate(lists):
        c = c.withColumn("_n", F.lit(n))
        out = c if out is None else out.unionByName(c, allowMissingColumns=True)
    w = W.partitionBy("aln_id", "i", "j").orderBy("_n", "cttype")
    return out.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_n")


def roc_by_rank(pred: DataFrame, contacts: DataFrame, min_len: int = 1) -> DataFrame:
    """(aln_id, rank, found, hits): predictions (aln_id, i, j, score) from the best, with running counts of contacts among them."""
    d = pred.where(F.col("j") - F.col("i") >= min_len).join(contacts.select("aln_id", "i", "j").distinct().withColumn("c", F.lit(1)), ["aln_id", "i", "j"], "left")
    w = W.partitionBy("aln_id").orderBy(F.desc("score"), "i", "j")
    return d.select("aln_id", F.row_number().over(w).alias("rank"), F.count(F.lit(1)).over(w.rowsBetween(W.unboundedPreceding, 0)).alias("found"), F.sum(F.coalesce("c", F.lit(0))).over(w.rowsBetween(W.unboundedPreceding, 0)).alias("hits"))
