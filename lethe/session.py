"""Session helpers: one place for the settings every job relies on."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings the engine depends on for correct results (UTC) and for a sane
# physical plan at any scale (AQE re-plans joins and coalesces partitions at
# runtime; the runtime bloom filter prunes the big side of selective joins).
ENGINE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    # 8-byte timestamps with statistics in what is written; the default of 12 bytes is dearer to encode
    "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
    # an erased table's parts are written side by side, so its rows need no sort by part
    "spark.sql.maxConcurrentOutputFileWriters": "8",
}


def build_session(master: str | None = None, app: str = "lethe",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the engine settings applied."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in ENGINE_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime-settable engine settings to an existing session."""
    for k, v in ENGINE_CONF.items():
        try:
            spark.conf.set(k, v)
        except Exception:  # static conf on a shared session: leave as is
            pass
    return spark


#: Scratch folders made, by application; ``release`` deletes them.
_MADE: dict[str, list[str]] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for lineage cuts and snapshots.

    On a cluster this is whatever the cluster names in ``spark.checkpoint.dir``
    (a shared file system).  Where it is unset, a local session uses a folder
    under its warehouse and any other session is refused: a folder of one
    machine's own would leave each executor with its own part.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        root = f"{warehouse.rstrip('/')}/scratch-{uuid.uuid4().hex[:12]}"
    sc.setCheckpointDir(root)
    return sc.getCheckpointDir() or root


def scratch_mark(spark: SparkSession) -> int:
    """A point in the list of scratch folders; ``release`` can delete what was made after it."""
    return len(_MADE.get(spark.sparkContext.applicationId, []))


def release(spark: SparkSession, since: int = 0) -> None:
    """Delete the scratch folders this session made (``since`` a mark); their DataFrames end with it."""
    jvm = spark.sparkContext._jvm
    made = _MADE.get(spark.sparkContext.applicationId, [])
    gone = made[since:]
    del made[since:]
    for path in gone:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint root."""
    path = os.path.join(checkpoint_root(spark), f"{name}-{uuid.uuid4().hex[:12]}")
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Writes inside delete their shuffle files when they end; otherwise these stay until the
    driver happens to collect the plan as garbage, and one write's lie beside the next one's."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def materialize(df, name: str, compression: str | None = None):
    """Cut lineage by writing ``df`` once as Parquet under the shared
    checkpoint root and reading it back.

    One job computes the data (an RDD checkpoint would compute it twice
    unless cached), the read-back carries file statistics for adaptive
    planning, and a lost executor only re-reads files."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)
