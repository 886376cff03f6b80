"""Tables written to the folder that every node of the cluster shares.

Iterative operators and plans that read an intermediate result more than once cut their lineage here: a table in the shared folder outlives any executor, so a lost one costs only
the tasks it was running. The folder is read from ``spark.checkpoint.dir``. Only a session without executors of its own (local mode:
tests, notebooks) may go without the setting; a temporary folder is set for it. On a cluster that is an error.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: lines of captures for each task
LINES = 40_000
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that every node shares")
        found = tempfile.mkdtemp(prefix="siftspark-checkpoint-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str, max_records: int = 0) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the plan of the result starts at files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/siftspark-{name}-{uuid.uuid4().hex}"
    writer = df.write
    if max_records:
        writer = writer.option("maxRecordsPerFile", max_records)
    writer.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._siftspark_path = path
    return out


def dealt(x: DataFrame, like: DataFrame, rows: int = LINES) -> DataFrame:
    """``x`` by capture, in as many parts as ``like`` has so many rows: what one task sorts stays the same as the tables grow. ``like`` should be cheap to count. Without a number
    of parts Spark would join them by their compressed bytes, and lines of captures shrink to a tenth."""
    return x.repartition(max(1, -(-like.count() // rows)), "capture_id")


def discard(*tables: DataFrame | None) -> None:
    """Delete tables that ``materialize`` wrote, once nothing reads them any more."""
    for df in tables:
        path = getattr(df, "_siftspark_path", None)
        if path:
            _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    _written[:] = [(s, p) for s, p in _written if p != path]


@atexit.register
def _clean() -> None:
    for spark, path in list(_written):
        if spark.sparkContext._jsc is not None:
            try:
                _delete(spark, path)
            except Exception:  # noqa: BLE001  the JVM may already have gone at interpreter exit
                return
