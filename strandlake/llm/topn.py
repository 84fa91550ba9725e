"""The best N items of every group by statistics-guided skipping.

``cluster`` writes the items sorted by (group, rank) over range partitions, so one group
lies in neighbouring row groups and a hot group in many files. ``top_n`` then reads only
footers, bounds every group's N-th rank from them, drops the row groups strictly beyond the
bound, and reads the rest of each file best first, skipping what its state rules out.
The layout can be kept and asked again for any N.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strandlake.storage import list_files, new_path

_CATALOG = "file string, rg int, gmin string, gmax string, kmin double, kmax double, n long"
_OUT = "g string, id long, k1 double, k2 double"


def _open_parquet(uri: str):
    import pyarrow.parquet as pq
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(uri)
    return pq.ParquetFile(where.open_input_file(path))


def _drop_repeats(batches):
    """Rows equal to the one before are the same item delivered twice; equal rows are never in two partitions."""
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(i) for i in range(4)]
        same = None
        for c in cols:
            a, z = c.slice(1), c.slice(0, len(c) - 1)
            eq = pc.or_(pc.fill_null(pc.equal(a, z), False), pc.and_(pc.is_null(a), pc.is_null(z)))
            same = eq if same is None else pc.and_(same, eq)
        first = tuple(c[0].as_py() for c in cols)
        keep = pa.concat_arrays([pa.array([first != last]), pc.invert(same)])
        last = tuple(c[len(c) - 1].as_py() for c in cols)
        yield b.filter(keep)


def cluster(items: DataFrame, group: str, item: str, first: F.Column, second: F.Column, row_group_rows: int = 2048) -> str:
    """Write the clustered layout and return its folder.

    ``first`` and ``second`` are rank expressions, smaller better, compared in this order and then
    by ``item``; a null second rank comes last. Items with a null group, or a null or NaN first rank, take no part.
    Range partitioning over the whole order splits a hot group at any place; as many files as the session has shuffle partitions, in
    row groups of ``row_group_rows`` items, so that what lies beyond a group's N-th can be skipped.
    """
    path = new_path(items.sparkSession, "clustered")
    # 0.0 is added so that -0.0 and 0.0 sort and compare as one value
    rows = items.select(F.col(group).alias("g"), (first + F.lit(0.0)).cast("double").alias("k1"), F.nanvl((second + F.lit(0.0)).cast("double"), F.lit(None).cast("double")).alias("k2"), F.col(item).cast("long").alias("id"))
    rows = rows.where(F.col("g").isNotNull() & F.col("k1").isNotNull() & ~F.isnan("k1") & F.col("id").isNotNull())
    order = [F.col("g"), F.col("k1"), F.col("k2").asc_nulls_last(), F.col("id")]
    files = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(files, *order).sortWithinPartitions(*order).mapInArrow(_drop_repeats, "g string, k1 double, k2 double, id long")
    rows.write.option("parquet.block.row.count.limit", row_group_rows).option("compression", "zstd").parquet(path)
    return path


def _footers(batches):
    for b in batches:
        out = []
        for uri in b.column(0).to_pylist():
            md = _open_parquet(uri).metadata
            for r in range(md.num_row_groups):
                rg = md.row_group(r)
                g, k = rg.column(0).statistics, rg.column(1).statistics
                gs = (g.min, g.max) if g is not None and g.has_min_max else (None, None)
                ks = (k.min, k.max) if k is not None and k.has_min_max else (None, None)
                gs = tuple(x.decode() if isinstance(x, bytes) else x for x in gs)
                out.append((uri, r, *gs, *ks, rg.num_rows))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()))], names=["file", "rg", "gmin", "gmax", "kmin", "kmax", "n"])


def _reader(n: int):
    """Catalogue rows, all of a file together and best first -> the first ``n`` of every group's run in each row group, one row group held at a time."""

    def read(batches):
        uri, pf, bound = None, None, {}
        for b in batches:
            for r in b.to_pylist():
                if r["file"] != uri:
                    uri, pf, bound = r["file"], _open_parquet(r["file"]), {}
                alone = r["gmin"] is not None and r["gmin"] == r["gmax"]
                if alone and r["kmin"] is not None and r["gmin"] in bound and r["kmin"] > bound[r["gmin"]]:
                    continue  # strictly beyond the N-th of the only group in it
                t = pf.read_row_group(r["rg"], columns=["g", "k1", "k2", "id"])
                g = t.column("g").combine_chunks()
                if not len(g):
                    continue
                starts = pc.indices_nonzero(pc.not_equal(g.slice(1), g.slice(0, len(g) - 1))).to_numpy() + 1
                starts = np.concatenate([[0], starts, [len(g)]]).astype(np.int64)
                lens = np.diff(starts)
                rank = np.arange(len(g)) - np.repeat(starts[:-1], lens)
                if alone and len(g) >= n:
                    kth = t.column("k1")[n - 1].as_py()
                    bound[r["gmin"]] = min(kth, bound.get(r["gmin"], kth))
                yield from t.filter(pa.array(rank < n)).select(["g", "id", "k1", "k2"]).to_batches()

    return read


def catalogue(spark, path: str, n: int) -> DataFrame:
    """(file, rg, gmin, gmax, kmin, kmax, n, wanted): the row groups of a clustered layout, from footers alone, and which can hold one of the best ``n``."""
    files = [(f,) for f, _ in list_files(spark, path)]
    if not files:
        return spark.createDataFrame([], _CATALOG + ", wanted boolean")
    cat = spark.createDataFrame(files, "file string").repartition(max(1, min(len(files), 2 * spark.sparkContext.defaultParallelism))).mapInArrow(_footers, _CATALOG)
    alone = F.col("gmin") == F.col("gmax")
    # at least n different items of the group are as good as the row group's worst
    bounds = cat.where(alone & (F.col("n") >= n) & F.col("kmax").isNotNull()).groupBy(F.col("gmin").alias("bg")).agg(F.min("kmax").alias("bound"))
    return cat.join(bounds, alone & (F.col("gmin") == F.col("bg")), "left").select(*cat.columns, F.expr("bound IS NULL OR kmin IS NULL OR kmin <= bound").alias("wanted"))


def top_n(spark, path: str, n: int) -> DataFrame:
    """(g, id, k1, k2, rank) of the best ``n`` of each group in a clustered layout; all if fewer."""
    if n < 1:
        return spark.createDataFrame([], _OUT + ", rank int")
    wanted = catalogue(spark, path, n).where("wanted").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file")
    found = wanted.sortWithinPartitions("file", F.col("kmin").asc_nulls_first(), "rg").mapInArrow(_reader(n), _OUT)
    w = W.partitionBy("g").orderBy("k1", F.col("k2").asc_nulls_last(), "id")
    # a run may go on in a neighbouring row group or file: at most n rows of each meet here
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def top_hits(hits: DataFrame, n: int = 5) -> DataFrame:
    """(queryname, hit_id, rank): the best ``n`` hits of each query, by e, then larger sc, then hit_id.

    Takes no part: queryname null; e null, NaN or negative. A null or NaN sc comes after all others. Rows
    delivered twice count once. Equal e and sc are settled by hit_id, so the result is fixed. No rows, no result;
    other columns, whatever their names, are not read.
    """
    ok = hits.where(F.col("queryname").isNotNull() & (F.col("e") >= 0) & ~F.isnan("e"))
    path = cluster(ok, "queryname", "hit_id", F.col("e"), -F.nanvl(F.col("sc"), F.lit(None).cast("double")))
    return top_n(hits.sparkSession, path, n).select(F.col("g").alias("queryname"), F.col("id").alias("hit_id"), "rank")
