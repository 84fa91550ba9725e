import math
from datetime import datetime

from strandlake.operators import reports as R
from strandlake.streaming.pair_counts import windowed_types


def test_stream_equals_batch(spark, tmp_path):
    rows = [(datetime(2024, 1, d, h), "click" if h % 2 else "view", float(h), d) for d in (1, 2) for h in range(0, 24, 3)]
    d = spark.createDataFrame(rows, "ts timestamp_ntz, event_type string, value double, user_id long")
    d.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    q = windowed_types(s).writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    got = {tuple(r) for r in spark.sql("select * from w").collect()}
    assert got == {tuple(r) for r in windowed_types(d).collect()} and len(got) == 4


def test_fisher_exact():
    # of 4 white and 4 black, 4 drawn: at least 3 white in (C(4,3)*C(4,1) + 1) / C(8,4) of the cases
    assert math.isclose(R.fisher_exact(3, 1, 1, 3), 17 / 70)
    assert math.isclose(R.fisher_exact(0, 2, 2, 0), 1.0)


def test_small_reports(spark):
    f = spark.createDataFrame([("a", 1, 2, 1, 50.0, 100.0, 66.0, 3.0, 1.0), ("b", 0, 2, 0, 0.0, 0.0, 0.0, 0.0, 0.0), ("c", 0, 2, 0, 0.0, 60.0, 0.0, 2.0, 1.5), ("d", 0, 9, 0, 0.0, 0.0, 0.0, 4.0, 5.0)], "family string, found int, true int, tp int, sen double, ppv double, f double, power double, expected double")
    assert [(r.family, r.band) for r in R.rank_families(f).orderBy("rank").collect()] == [("a", "high"), ("d", "low"), ("c", "middle"), ("b", "low")]
    assert {r.family: r.segment for r in R.segments(f).collect()} == {"a": "covaries", "b": "no power", "c": "grey zone", "d": "power without covariation"}
    s = "aln_id string, i int, j int"
    a, b = spark.createDataFrame([("x", 1, 5), ("y", 1, 5), ("z", 1, 5)], s), spark.createDataFrame([("x", 1, 5), ("x", 2, 4), ("z", 2, 4)], s)
    assert {r.aln_id: r.verdict for r in R.compare_structures(a, b).collect()} == {"x": "better", "y": "worse", "z": "different"}
    h = spark.createDataFrame([(1, 50, 120), (2, 300, 90), (3, 600, 700), (4, None, 5)], "hit_id int, sqfrom int, sqto int")
    assert {(r.hit_id, r.cfrom, r.cto) for r in R.clip_hits(h, 100, 200).collect()} == {(1, 100, 120), (2, 100, 200)}
    d = spark.createDataFrame([("k", float(x), 2.0 * x + 1) for x in range(5)] + [("k", 50.0, 0.0), ("m", 1.0, 1.0)], "k string, x double, y double")
    got = {r.k: (r.slope, r.intercept) for r in R.censored_regression(d, "k", "x", "y", 10.0).collect()}
    assert math.isclose(got["k"][0], 2) and math.isclose(got["k"][1], 1) and got["m"] == (0, 0)
