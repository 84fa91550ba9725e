"""The folder that all executors share, and tables written there to cut lineage.

Intermediate tables go below ``spark.checkpoint.dir``. Only where that setting is
absent and the master is local (tests, benches) a temporary folder takes its place.
A written table survives the loss of any executor, unlike a local checkpoint.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """URI of this application's part of the shared folder."""
    app = spark.sparkContext.applicationId
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if app not in _LOCAL:
            _LOCAL[app] = tempfile.mkdtemp(prefix="strandlake-")
            atexit.register(shutil.rmtree, _LOCAL[app], ignore_errors=True)
        root = "file://" + _LOCAL[app]
    return f"{root.rstrip('/')}/strandlake/{app}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later stages start from files."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path  # for release()
    return out


def release(*frames: DataFrame) -> None:
    """Delete written tables that no later plan reads."""
    for df in frames:
        if path := getattr(df, "_written_at", None):
            _fs(df.sparkSession, path)[0].delete(_fs(df.sparkSession, path)[1], True)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def list_files(spark: SparkSession, path: str, suffix: str = ".parquet") -> list[tuple[str, int]]:
    """(URI, bytes) of the data files in one folder; as many as its writer had tasks."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    return sorted((str(s.getPath().toString()), int(s.getLen())) for s in fs.listStatus(p) if s.getPath().getName().endswith(suffix))


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files below a plan, as the scan sees them."""
    total = 0
    spark = df.sparkSession
    for f in df.inputFiles():
        fs, p = _fs(spark, f)
        total += int(fs.getFileStatus(p).getLen())
    return total
