"""Per-key results when a few keys hold most records.

Everything is a mergeable count: rows are combined on the map side, a hot key meets
its brackets in salted pieces, and exact quantiles come from histograms refined round
by round, so no task ever holds the values of a hot key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strandlake.storage import materialize


def exact_quantiles(counts: DataFrame, probs: tuple[float, ...], bins: int = 64, salts: int = 16, max_rounds: int = 200) -> DataFrame:
    """Exact lower quantiles of ``v`` in every ``key`` by distributed selection.

    counts: (key, v DOUBLE, n BIGINT), any number of rows for a (key, v). The result is
    (key, prob, quantile, upto_n, upto_v): the smallest value whose cumulated count reaches
    ceil(prob * total), at least 1, and how many values stand at or below it and what they sum to, from the same
    histograms: of ``prob`` 1 that is all of the key. A null key is a key of its own and drops out; null and NaN
    values take no part; an empty input gives no rows. Ties cost nothing: they share a bin.

    Each round splits every open bracket [lo, hi] into ``bins`` bins, counts rows in them and
    keeps the bin in which the wanted rank falls, with the least and largest value really
    in it as the new bracket. A bracket of one value is resolved. Rounds stop when none is
    open: about log(range)/log(bins), 11 for any doubles that are not pathological.
    """
    spark = counts.sparkSession
    clean = counts.where(F.col("key").isNotNull() & F.col("v").isNotNull() & ~F.isnan("v"))
    rows = clean.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(salts)).cast("int"))
    start = clean.groupBy("key").agg(F.sum("n").alias("total"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    probs_col = F.array(*(F.lit(float(p)) for p in probs))
    start = start.select("key", F.explode(probs_col).alias("prob"), F.greatest(F.lit(1), F.ceil(F.col("total") * F.col("prob"))).cast("long").alias("rank"), "lo", "hi")
    # what stands below the bracket, and in it once it is closed
    brackets = materialize(start.withColumns({"below_n": F.lit(0).cast("long"), "below_v": F.lit(0.0), "in_n": F.lit(None).cast("long"), "in_v": F.lit(None).cast("double")}), "brackets")
    result = lambda d: d.select("key", "prob", F.col("lo").alias("quantile"), (F.col("below_n") + F.col("in_n")).alias("upto_n"), (F.col("below_v") + F.col("in_v")).alias("upto_v"))
    finished, open_ = [], brackets
    for _ in range(max_rounds):
        if open_.isEmpty():
            break
        # one histogram for each distinct bracket of a key: several ranks may share it
        spans = open_.select("key", "lo", "hi").distinct().withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        # the scaled difference cannot overflow, and the bounds' bins are the first and the last
        width = F.col("hi") / bins - F.col("lo") / bins
        bin_ = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((F.col("v") / 1 - F.col("lo")) / width))).cast("int")
        bin_ = F.when(F.col("v") == F.col("hi"), bins - 1).otherwise(F.coalesce(bin_, F.lit(0))).alias("bin")
        hist = rows.join(spans, ["key", "salt"]).where("v >= lo AND v <= hi").groupBy("key", "lo", "hi", bin_).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("v")).alias("s"), F.min("v").alias("vmin"), F.max("v").alias("vmax"))
        up = W.partitionBy("key", "lo", "hi").orderBy("bin")
        cum = hist.withColumn("upto", F.sum("n").over(up)).withColumn("upto_s", F.sum("s").over(up))
        hit = open_.join(cum, ["key", "lo", "hi"]).where("rank <= upto AND rank > upto - n")
        before = F.col("upto") - F.col("n")
        nxt = hit.select("key", "prob", (F.col("rank") - before).alias("rank"), F.col("vmin").alias("lo"), F.col("vmax").alias("hi"), (F.col("below_n") + before).alias("below_n"), (F.col("below_v") + F.col("upto_s") - F.col("s")).alias("below_v"), F.col("n").alias("in_n"), F.col("s").alias("in_v"))
        nxt = materialize(nxt, "brackets")
        finished.append(result(nxt.where("lo = hi")))
        open_ = nxt.where("lo < hi")
    else:
        raise RuntimeError("quantile brackets did not close")
    if not finished:
        return result(brackets)
    out = finished[0]
    for f in finished[1:]:
        out = out.unionByName(f)
    return out


def key_profile(rows: DataFrame, row_id: str, member: str, size: str, members: DataFrame, member_key: str, name: str, declared: tuple[str, str], probs: tuple[float, ...] = (0.5, 0.9)) -> tuple[DataFrame, int, int]:
    """Records and their sizes for each name, next to what the name's members declare.

    rows: one row for each record (``row_id``, ``member``, ``size``), members: one row for each
    member with its name and two declared counts; both without repeated keys. Returns the profile
    (name, n_members, declared_a, declared_b, n_rows, n_chars, one column for each quantile of size), all of it but the declared
    from the refined histograms, and the totals over all rows, whether or not their member has a name.

    Names without rows have 0 rows and null quantiles; null names are left out; a null size counts
    as a row of 0 characters; declared values that are null or not positive count as 0.
    """
    per_member = rows.groupBy(F.col(member).alias("m"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("s")).agg(F.count(F.lit(1)).alias("n"))
    per_member = materialize(per_member, "member_sizes")  # two numbers a member and length, not the rows
    total = per_member.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("n") * F.col("s")), F.lit(0)).alias("c")).first()
    named = members.select(F.col(member_key).alias("m"), F.col(name).alias("key"), *(F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0)).cast("long").alias(k) for c, k in zip(declared, ("da", "db")))).where(F.col("key").isNotNull())
    counts = materialize(per_member.join(named.select("m", "key"), "m").groupBy("key", F.col("s").cast("double").alias("v")).agg(F.sum("n").alias("n")), "key_sizes")
    declared_ = named.groupBy("key").agg(F.count(F.lit(1)).alias("n_members"), F.sum("da").alias("declared_a"), F.sum("db").alias("declared_b"))
    cols = [f"q{round(p * 100):02d}" for p in probs]
    quant = exact_quantiles(counts, (*probs, 1.0))
    at = lambda p: F.abs(F.col("prob") - p) < 1e-12
    quant = quant.groupBy("key").agg(*(F.max(F.when(at(p), F.col("quantile"))).cast("long").alias(c) for p, c in zip(probs, cols)), F.max(F.when(at(1.0), F.col("upto_n"))).alias("n_rows"), F.max(F.when(at(1.0), F.col("upto_v"))).cast("long").alias("n_chars"))
    out = declared_.join(quant, "key", "left")
    out = out.select(F.col("key").alias("name"), "n_members", "declared_a", "declared_b", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("n_chars", F.lit(0)).alias("n_chars"), *cols)
    return out, int(total["n"]), int(total["c"])
