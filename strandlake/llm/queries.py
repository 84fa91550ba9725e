"""The pN_ queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best hits of each query."""
    from strandlake.llm.topn import top_hits

    return top_hits(table(spark, sf_dir, "domain_hits"), 5).select("queryname", "hit_id")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of rows with at least 90 % of their residues alike."""
    from strandlake.llm.neardup import near_pairs

    return near_pairs(table(spark, sf_dir, "seqs"), "seq_id", "aseq").select(F.col("a").alias("seq_id_a"), F.col("b").alias("seq_id_b"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping pieces of the rows longer than 400 columns."""
    from strandlake.llm.split import split_rows

    return split_rows(table(spark, sf_dir, "seqs"), "seq_id", "aseq")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of rows that a configuration may not both choose."""
    from strandlake.llm.diverse import similar_pairs

    return similar_pairs(table(spark, sf_dir, "seqs").select("seq_id", "aln_id", "aseq"), table(spark, sf_dir, "filter_cfg"))


def p4_chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The varied subset of each configuration."""
    from strandlake.llm.diverse import choose

    return choose(table(spark, sf_dir, "seqs").select("seq_id", "aln_id", "aseq", "wgt"), table(spark, sf_dir, "filter_cfg"))


def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in containers of 2048 tokens."""
    from strandlake.llm.pack import assign, token_counts

    return assign(token_counts(table(spark, sf_dir, "documents")))


def p6_certificates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers used and the certified least number, by part."""
    from strandlake.llm.pack import assign, certificates, token_counts

    return certificates(assign(token_counts(table(spark, sf_dir, "documents"))))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the test items they contain."""
    from strandlake.llm.leak import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects that at least a quarter of a document's sentences are about."""
    from strandlake.llm.subjects import classify, train_on

    docs = table(spark, sf_dir, "documents")
    model = train_on(docs, table(spark, sf_dir, "doc_labels"), table(spark, sf_dir, "subject_areas"))
    return classify(docs, model).select("doc_id", "subject")


def p8_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each subject, their part of all documents, and the mean share of sentences in those that have it."""
    from strandlake.llm.subjects import classify, train_on

    docs = table(spark, sf_dir, "documents")
    model = train_on(docs, table(spark, sf_dir, "doc_labels"), table(spark, sf_dir, "subject_areas"))
    n = docs.agg(F.countDistinct("doc_id").alias("n")).first()["n"]
    got = classify(docs, model).groupBy("subject").agg(F.count(F.lit(1)).alias("n_docs"), F.round(F.avg("share"), 4).alias("mean_share_where_assigned"))
    return got.select("subject", "n_docs", F.round(F.col("n_docs") / F.lit(n), 6).alias("part_of_docs"), "mean_share_where_assigned")


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p3_found": p3_found, "p4_found": p4_found, "p4_chosen": p4_chosen, "p6_packed": p6_packed, "p6_certificates": p6_certificates, "p7_found": p7_found, "p8_found": p8_found, "p8_composition": p8_composition}

ORACLE = {
    "p1_found": """
WITH h AS (SELECT DISTINCT queryname, hit_id, e, CASE WHEN isnan(sc) THEN NULL ELSE sc END AS sc FROM domain_hits WHERE queryname IS NOT NULL AND hit_id IS NOT NULL AND e >= 0 AND NOT isnan(e)),
r AS (SELECT *, row_number() OVER (PARTITION BY queryname ORDER BY e, sc DESC NULLS LAST, hit_id) AS rn FROM h)
SELECT queryname, hit_id FROM r WHERE rn <= 5""",
    "p3_found": r"""
WITH RECURSIVE r AS (SELECT seq_id, min(aseq) AS a FROM seqs WHERE length(aseq) > 400 GROUP BY seq_id),
c AS (SELECT seq_id, length(a) AS n, list_filter(range(4, length(a) + 1), lambda i: regexp_matches(substr(a, i - 3, 3), '^[-._~]{3}$') AND regexp_matches(substr(a, i, 1), '^[A-Za-z]$')) AS nxt FROM r),
w AS (SELECT seq_id, n, nxt, CAST(1 AS BIGINT) AS piece_no, CAST(1 AS BIGINT) AS s, CASE WHEN n <= 400 THEN n ELSE coalesce(list_max(list_filter(nxt, lambda x: x - 1 BETWEEN 201 AND 400)) - 1, 400) END AS e FROM c
UNION ALL
SELECT seq_id, n, nxt, piece_no + 1, e - 39, CASE WHEN n <= e + 360 THEN n ELSE coalesce(list_max(list_filter(nxt, lambda x: x - 1 BETWEEN e + 161 AND e + 360)) - 1, e + 360) END FROM w WHERE e < n)
SELECT CAST(seq_id AS BIGINT) AS seq_id, CAST(piece_no AS INTEGER) AS piece_no, CAST(s AS INTEGER) AS start_col, CAST(e AS INTEGER) AS end_col FROM w""",
    "p4_found": r"""
WITH f AS (SELECT cfg_id, min(aln_id) AS aln_id, min(idthresh) AS t FROM filter_cfg WHERE cfg_id IS NOT NULL GROUP BY cfg_id),
g AS (SELECT cfg_id, aln_id, CASE WHEN t > 1 THEN t / 100 ELSE t END AS thr FROM f WHERE t IS NOT NULL AND NOT isnan(t) AND t >= 0 AND t <> 1),
s AS (SELECT seq_id, min(aln_id) AS aln_id, replace(upper(min(aseq)), 'T', 'U') AS a FROM seqs WHERE aln_id IN (SELECT aln_id FROM g) GROUP BY seq_id),
c AS (SELECT aln_id, seq_id, a, length(regexp_replace(a, '[^A-Z]', '', 'g')) AS n FROM s WHERE regexp_matches(a, '[A-Z]')),
p AS (SELECT x.aln_id, x.seq_id AS i, y.seq_id AS j, len(list_filter(range(1, least(length(x.a), length(y.a)) + 1), lambda k: x.a[k] = y.a[k] AND x.a[k] BETWEEN 'A' AND 'Z')) / least(x.n, y.n) AS ident FROM c x JOIN c y ON x.aln_id = y.aln_id AND x.seq_id < y.seq_id)
SELECT g.cfg_id, i AS seq_id_a, j AS seq_id_b FROM p JOIN g USING (aln_id) WHERE ident >= thr""",
}
