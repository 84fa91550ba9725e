"""Queries on whole alignments: filters, recoding, weights, shuffles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators import filters as X
from strandlake.operators import pseudo
from strandlake.plans import oracle as O
from strandlake.plans.covariation import rnd
from strandlake.tables import once, table


def rows(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return once(table(spark, sf_dir, "seqs"), "seq_id", "aln_id", "aseq", *more).where("aln_id IS NOT NULL")


def gap_columns(spark, sf_dir) -> DataFrame:
    """Columns kept by a gap filter of one half, with their new places."""
    return X.keep_columns(rows(spark, sf_dir), 0.5)


def whole_rows(spark, sf_dir) -> DataFrame:
    return X.whole_rows(rows(spark, sf_dir), 0.7).select("aln_id", "seq_id", F.col("len").cast("long").alias("len"))


def recoded(spark, sf_dir) -> DataFrame:
    """Rows with degenerate letters as N and missing data as gaps."""
    return rows(spark, sf_dir).where("aseq IS NOT NULL").select("seq_id", X.recode(F.col("aseq")).alias("aseq"))


def doctored_names(spark, sf_dir) -> DataFrame:
    return rows(spark, sf_dir, "sqname").select("seq_id", X.doctor_name(F.col("sqname")).alias("name"))


def unique_names(spark, sf_dir) -> DataFrame:
    return X.unique_names(rows(spark, sf_dir, "sqname")).select("aln_id", "seq_id", "uname")


def sliding_windows(spark, sf_dir) -> DataFrame:
    """Windows of 100 columns every 50, over each alignment's real width."""
    return X.windows(rows(spark, sf_dir).groupBy("aln_id").agg(F.max(F.length("aseq")).alias("alen")))


def sampled_rows(spark, sf_dir) -> DataFrame:
    return X.sample_rows(rows(spark, sf_dir), 3, 7).select("aln_id", "seq_id")


def base_composition(spark, sf_dir) -> DataFrame:
    return X.base_composition(rows(spark, sf_dir))


def msa_stats(spark, sf_dir) -> DataFrame:
    s = X.msa_stats(rows(spark, sf_dir))
    return s.select("aln_id", "nseq", "alen", *(rnd(F.col(c)).alias(c) for c in ("mean_len", "sd_len")), "n_runs", rnd(F.col("mean_run")).alias("mean_run"), "max_run")


def pb_weights(spark, sf_dir) -> DataFrame:
    return X.pb_weights(rows(spark, sf_dir)).select("aln_id", "seq_id", rnd(F.col("w")).alias("w"))


def pair_identity(spark, sf_dir) -> DataFrame:
    return X.pair_identity(pseudo.embeddings_cells(spark, sf_dir)).select("aln_id", "a", "b", "same", rnd(F.col("ident")).alias("ident"))


def hamming_weights(spark, sf_dir) -> DataFrame:
    c = pseudo.events_cells(spark, sf_dir)
    return X.hamming_weights(X.pair_identity(c), c.select("aln_id", "seq").distinct(), 0.7).select("aln_id", "seq", rnd(F.col("w")).alias("w"))


def shuffled_columns(spark, sf_dir) -> DataFrame:
    return X.shuffle_columns(pseudo.events_cells(spark, sf_dir), 3)


def shuffled_within_columns(spark, sf_dir) -> DataFrame:
    return X.shuffle_within_columns(pseudo.events_cells(spark, sf_dir), 3, 2)


def shuffled_within_rows(spark, sf_dir) -> DataFrame:
    return X.shuffle_within_rows(pseudo.events_cells(spark, sf_dir), 3)


QUERIES = {f.__name__: f for f in (gap_columns, whole_rows, recoded, doctored_names, unique_names, sliding_windows, sampled_rows, base_composition, msa_stats, pb_weights, pair_identity, hamming_weights, shuffled_columns, shuffled_within_columns, shuffled_within_rows)}

_ROWS = "rows AS (SELECT seq_id, min(aln_id) AS aln_id, min(aseq) AS aseq, min(sqname) AS sqname FROM seqs WHERE seq_id IS NOT NULL GROUP BY seq_id HAVING min(aln_id) IS NOT NULL)"
_LONG = _ROWS + ", long AS (SELECT aln_id, seq_id, k AS col, replace(upper(aseq[k]), 'T', 'U') AS sym FROM rows, LATERAL (SELECT unnest(range(1, length(aseq) + 1)) AS k))"
_LET = "length(regexp_replace(aseq, '[^A-Za-z]', '', 'g'))"
_IDENT = "n AS (SELECT aln_id, seq, count(*) AS n FROM cells WHERE res < 4 GROUP BY 1, 2), ident AS (SELECT a.aln_id, a.seq AS a, b.seq AS b, count(*) FILTER (WHERE c.res = d.res) AS same, any_value(least(a.n, b.n)) AS m FROM n a JOIN n b ON a.aln_id = b.aln_id AND a.seq < b.seq JOIN cells c ON c.aln_id = a.aln_id AND c.seq = a.seq AND c.res < 4 LEFT JOIN cells d ON d.aln_id = b.aln_id AND d.seq = b.seq AND d.col = c.col AND d.res < 4 GROUP BY 1, 2, 3)"


def _perm(within: str, other: str, reps: int) -> str:
    return f"""WITH {O.CELLS["events"]}, c AS (SELECT cells.*, CAST(rep AS INTEGER) AS rep FROM cells, range(1, {reps + 1}) t(rep) WHERE res < 4),
o AS (SELECT *, row_number() OVER (PARTITION BY aln_id, rep, {within} ORDER BY {other}) AS o, row_number() OVER (PARTITION BY aln_id, rep, {within} ORDER BY md5(concat_ws('|', 3, rep, aln_id, {within}, {other})), {other}) AS n FROM c)
SELECT a.aln_id, a.rep, a.seq, a.col, b.res FROM o a JOIN o b ON a.aln_id = b.aln_id AND a.rep = b.rep AND a.{within} = b.{within} AND a.o = b.n"""


ORACLE = {
    "gap_columns": f"""WITH {_LONG}, c AS (SELECT aln_id, col, count(*) FILTER (WHERE sym BETWEEN 'A' AND 'Z') AS r, count(*) FILTER (WHERE sym <> '~') AS t FROM long GROUP BY 1, 2)
SELECT aln_id, CAST(col AS INTEGER) AS col, CAST(row_number() OVER (PARTITION BY aln_id ORDER BY col) - 1 AS INTEGER) AS i FROM c WHERE r > 0 AND r >= 0.5 * t""",
    "whole_rows": f"WITH {_ROWS}, l AS (SELECT aln_id, seq_id, coalesce({_LET}, 0) AS len FROM rows), m AS (SELECT *, avg(len) OVER (PARTITION BY aln_id) AS mean FROM l) SELECT aln_id, seq_id, len FROM m WHERE len > CAST(0.7 AS DOUBLE) * mean",
    "recoded": f"WITH {_ROWS} SELECT seq_id, replace(regexp_replace(replace(upper(aseq), 'T', 'U'), '[B-FH-TV-Z]', 'N', 'g'), '~', '-') AS aseq FROM rows WHERE aseq IS NOT NULL",
    "doctored_names": f"WITH {_ROWS} SELECT seq_id, translate(trim(sqname), '([)]; ', '{{{{}}}}__') AS name FROM rows",
    "unique_names": f"""WITH {_ROWS}, u AS (SELECT *, count(*) OVER (PARTITION BY aln_id, sqname) AS n, row_number() OVER (PARTITION BY aln_id ORDER BY seq_id) AS p FROM rows)
SELECT aln_id, seq_id, CASE WHEN n > 1 OR sqname IS NULL THEN lpad(CAST(p AS VARCHAR), 6, '0') || '_' || coalesce(sqname, '') ELSE sqname END AS uname FROM u""",
    "sliding_windows": f"""WITH {_ROWS}, w AS (SELECT aln_id, max(length(aseq)) AS alen FROM rows GROUP BY 1 HAVING max(length(aseq)) >= 1)
SELECT aln_id, CAST((k - 1) // 50 AS INTEGER) AS "window", CAST(k AS INTEGER) AS "first", CAST(least(k + 99, alen) AS INTEGER) AS "last" FROM w, LATERAL (SELECT unnest(range(1, alen + 1, 50)) AS k)""",
    "sampled_rows": f"WITH {_ROWS}, s AS (SELECT *, row_number() OVER (PARTITION BY aln_id ORDER BY md5(concat_ws('|', 7, seq_id)), seq_id) AS r FROM rows) SELECT aln_id, seq_id FROM s WHERE r <= 3",
    "base_composition": f"""WITH {_ROWS}, t AS (SELECT aln_id, replace(upper(coalesce(aseq, '')), 'T', 'U') AS a FROM rows)
SELECT aln_id, {", ".join(f"CAST(sum(length(a) - length(replace(a, '{x}', ''))) AS BIGINT) AS n_{x.lower()}" for x in "ACGU")}, CAST(sum(length(regexp_replace(a, '[^A-Z]|[ACGU]', '', 'g'))) AS BIGINT) AS n_other FROM t GROUP BY aln_id""",
    "msa_stats": f"""WITH {_ROWS}, d AS (SELECT aln_id, coalesce({_LET}, 0) AS len, coalesce(length(aseq), 0) AS w, list_transform(regexp_extract_all(coalesce(aseq, ''), '[-._]+'), lambda x: length(x)) AS runs FROM rows)
SELECT aln_id, count(*) AS nseq, CAST(max(w) AS INTEGER) AS alen, {O.r("avg(len)", "mean_len")}, {O.r("coalesce(stddev_samp(len), 0)", "sd_len")}, CAST(sum(len(runs)) AS BIGINT) AS n_runs, {O.r("CASE WHEN sum(len(runs)) > 0 THEN sum(coalesce(list_sum(runs), 0)) / sum(len(runs)) ELSE 0 END", "mean_run")}, CAST(max(coalesce(list_max(runs), 0)) AS INTEGER) AS max_run FROM d GROUP BY aln_id""",
    "pb_weights": f"""WITH {_LONG}, c AS (SELECT * FROM long WHERE sym BETWEEN 'A' AND 'Z'), n AS (SELECT aln_id, col, sym, count(*) AS n FROM c GROUP BY ALL), s AS (SELECT aln_id, col, sym, 1.0 / (count(*) OVER (PARTITION BY aln_id, col) * n) AS s FROM n),
p AS (SELECT c.aln_id, seq_id, sum(CAST(s AS DOUBLE)) AS s FROM c JOIN s ON s.aln_id = c.aln_id AND s.col = c.col AND s.sym = c.sym GROUP BY 1, 2)
SELECT aln_id, seq_id, {O.r("s * count(*) OVER (PARTITION BY aln_id) / sum(s) OVER (PARTITION BY aln_id)", "w")} FROM p""",
    "pair_identity": f"WITH {O.CELLS['embeddings']}, {_IDENT} SELECT aln_id, a, b, same, {O.r('same / m', 'ident')} FROM ident",
    "hamming_weights": f"""WITH {O.CELLS["events"]}, {_IDENT}, k AS (SELECT aln_id, seq, count(*) AS k FROM (SELECT aln_id, a AS seq FROM ident WHERE 1 - same / m < CAST(0.7 AS DOUBLE) UNION ALL SELECT aln_id, b FROM ident WHERE 1 - same / m < CAST(0.7 AS DOUBLE)) GROUP BY 1, 2)
SELECT s.aln_id, s.seq, {O.r("1.0 / (1 + coalesce(k, 0))", "w")} FROM (SELECT DISTINCT aln_id, seq FROM cells) s LEFT JOIN k ON k.aln_id = s.aln_id AND k.seq = s.seq""",
    "shuffled_columns": f"""WITH {O.CELLS["events"]}, c AS (SELECT DISTINCT aln_id, col FROM cells), o AS (SELECT *, row_number() OVER (PARTITION BY aln_id ORDER BY col) AS o, row_number() OVER (PARTITION BY aln_id ORDER BY md5(concat_ws('|', 3, 1, aln_id, col)), col) AS n FROM c)
SELECT cells.aln_id, CAST(1 AS INTEGER) AS rep, seq, b.col, res FROM cells JOIN o a ON a.aln_id = cells.aln_id AND a.col = cells.col JOIN o b ON b.aln_id = a.aln_id AND b.o = a.n""",
    "shuffled_within_columns": _perm("col", "seq", 2),
    "shuffled_within_rows": _perm("seq", "col", 1),
}
