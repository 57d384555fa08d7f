"""Session helpers: a session builder, the shared checkpoint folder, stored tables."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app: str = "surveil", extra: dict[str, str] | None = None) -> SparkSession:
    """Session with the settings this library is tuned for.

    Neither a master nor a shuffle partition count is set unless the caller asks for it (tests and
    the bench do), so spark-submit's own settings hold on a cluster. We pin UTC (all times are
    epoch millis, UTC-naive), keep AQE on so shuffle partitions coalesce and skewed joins split
    at runtime, and keep the UI off.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master).config("spark.driver.memory", os.environ.get("SURVEIL_DRIVER_MEMORY", "16g"))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    b = (b.config("spark.ui.enabled", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.cleaner.referenceTracking.cleanCheckpoints", os.environ.get("SURVEIL_CLEAN_CHECKPOINTS", "true"))
         .config("spark.sql.streaming.stateStore.providerClass",
                 "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession, sub: str = "") -> str:
    """The shared checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    Unset on a cluster this raises: executors and driver share no local folder. Only a local
    master (tests, bench) falls back to a scratch folder of this machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or \
        spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            base = os.path.dirname(current.get())
        elif re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            base = tempfile.mkdtemp(prefix="surveil-ckpt-")
        else:
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/") + ("/" + sub if sub else "")


def stored(df, name: str = "table"):
    """Write ``df`` once as a table in the shared checkpoint folder and return a scan of it.

    Cuts lineage like a checkpoint, but keeps column pruning and file-size statistics, so the
    planner sees how large the table really is. Compressed with zstd: written once, read a few times."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd")
    return spark.read.schema(df.schema).parquet(path)


def cut_lineage(df):
    """Checkpoint ``df`` into the shared checkpoint folder and return the checkpointed frame.

    The frame is persisted first so the checkpoint write reuses the computed partitions
    instead of running the plan a second time; the cache is dropped once written.
    Survives executor loss (files, not executor memory); never a local checkpoint."""
    checkpoint_dir(df.sparkSession)
    cached = df.persist()
    out = cached.checkpoint(eager=True)
    cached.unpersist()
    return out
