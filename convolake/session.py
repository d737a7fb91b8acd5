"""Session helpers.

Library code never creates its own session; tests, ``bench.py`` and the
examples call :func:`get_spark`.  Settings that a cluster operator owns
(checkpoint dir, shuffle partitions, memory) are only filled in when the
session has none, so the same code runs unchanged on a large cluster.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings applied when building a local session (tests / bench).  On a
# cluster the submitter's spark-defaults win because getOrCreate() returns
# the existing session.
LOCAL_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # broadcast joins are only chosen for sides Spark itself measured below
    # this bound; explicit hints are only used on parameter tables.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
}


def get_spark(app: str = "convolake", master: str | None = None,
              shuffle_partitions: int | None = None, extra_conf: dict | None = None) -> SparkSession:
    """Return the active session, building a local one if none exists."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.appName(app).master(master or f"local[{cpus}]")
    for k, v in LOCAL_DEFAULTS.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.sql.shuffle.partitions",
                             str(shuffle_partitions or int(cpus)))
    builder = builder.config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "16g"))
    for k, v in (extra_conf or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting names a shared, fault-tolerant folder and is
    read as is.  Only when it is unset (local tests) a fresh scratch folder
    is created and registered with the context (the setting itself cannot be
    changed on a running session).
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    sc = None
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect has no local context
        pass
    if not d and sc is not None:
        d = sc.getCheckpointDir()
    if not d and sc is not None and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not d:
        d = tempfile.mkdtemp(prefix="convolake-ckpt-", dir="/tmp")
    if sc is not None and not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d


def rocksdb_session(spark):
    """A session on the same cluster whose streams keep their state in RocksDB,
    which keyed state with timers needs; the settings of ``spark`` stay."""
    own = spark.newSession()
    for key in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
        own.conf.set(key, spark.conf.get(key))
    own.conf.set("spark.sql.streaming.stateStore.providerClass",
                 "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return own


#: settings that bound what a Python worker is handed at once
BATCH_ROWS, BATCH_BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession, rows: int = 500, size: int = 2 << 20):
    """Actions inside hand a Python worker at most ``rows`` rows and about
    ``size`` bytes at once, for rows that hold whole files or texts; smaller
    settings of the session stay."""
    as_bytes = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    before = {key: spark.conf.get(key, None) for key in (BATCH_ROWS, BATCH_BYTES)}
    try:
        for key, most in ((BATCH_ROWS, rows), (BATCH_BYTES, size)):
            now = int(as_bytes(spark.conf.get(key)))
            spark.conf.set(key, str(min(now, most) if now > 0 else most))
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def staged(df, name: str):
    """``df`` written once to the shared folder and read back.  Cuts the lineage
    like a checkpoint, without computing ``df`` twice; the files go when the
    application ends."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/convolake-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hpath)
    return spark.read.schema(df.schema).parquet(path)


def cut_lineage(df):
    """Reliable checkpoint into the shared checkpoint dir (never local)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
