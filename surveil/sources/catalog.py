"""Medallion namespaces and layer tables.

One catalog, seven schemas (bronze, silver, gold, alerts, governed_output, eval, ml).
Tables are written as files under a root folder (parquet by default, any format the
cluster has, e.g. delta) partitioned by event day, and registered in the session catalog
so they can be queried by name with partition pruning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveil.schemas import NAMESPACES


def ensure_namespaces(spark: SparkSession, prefix: str = "surveil") -> list[str]:
    names = [f"{prefix}_{ns}" for ns in NAMESPACES]
    for n in names:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {n}")
    return names


def event_date(time_col: str, granularity: str = "day") -> F.Column:
    """UTC day (or first day of the month) of an epoch-ms column, independent of the session TZ."""
    d = F.date_from_unix_date(F.floor(F.col(time_col) / F.lit(86_400_000)).cast("int"))
    return F.trunc(d, "month") if granularity == "month" else d


def write_layer(df: DataFrame, root: str, layer: str, name: str, fmt: str = "parquet",
                time_col: str | None = "transact_time", prefix: str = "surveil", granularity: str = "day",
                mode: str = "overwrite", replace_days: bool = False) -> str:
    """Write ``df`` to ``root/layer/name`` partitioned by event day (or month) and register it.

    Rows are clustered by day first (AQE splits large days), so a task writes few files.
    ``replace_days`` overwrites only the days that ``df`` holds and leaves the others.

    Daily partitions suit production volumes (each day holds a large slice); for sparse
    data spread over years, ``granularity="month"`` avoids thousands of tiny partitions."""
    if layer not in NAMESPACES:
        raise ValueError(f"unknown layer {layer!r}")
    path = f"{root.rstrip('/')}/{layer}/{name}"
    w = df
    parts: list[str] = []
    if time_col and time_col in df.columns and granularity in ("day", "month"):
        w = df.withColumn("event_date", event_date(time_col, granularity))
        parts = ["event_date"]
    if parts:
        w = w.hint("rebalance", "event_date")
    writer = w.write.mode(mode).format(fmt)
    if replace_days and parts:
        writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*parts).save(path)
    spark = df.sparkSession
    table = f"{prefix}_{layer}.{name}"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {prefix}_{layer}")
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    # the schema is given, so a layer without rows (say, an empty quarantine) is a table as well
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in w.schema.fields)
    by = f"PARTITIONED BY ({', '.join(parts)})" if parts else ""
    spark.sql(f"CREATE TABLE {table} ({columns}) USING {fmt} {by} LOCATION '{path}'")
    if parts:
        spark.sql(f"MSCK REPAIR TABLE {table}")
    return table


def write_time_ordered(df: DataFrame, path: str, n_files: int | None = None, fmt: str = "parquet") -> None:
    """Files in event-time order: range partitions on (time, id, type) then a local sort. The file
    count is ``n_files``, or else follows the session's shuffle partitions and AQE's target size.

    The id and type keys make the range boundaries split even a single hot timestamp,
    and no global single-task sort is needed."""
    keys = ["transact_time", "cl_ord_id", "msg_type"]
    ranged = df.repartitionByRange(n_files, *keys) if n_files else df.repartitionByRange(*keys)
    ranged.sortWithinPartitions(*keys).write.mode("overwrite").format(fmt).save(path)


WINDOW_KEYS = ["trader_id", "symbol", "window_start"]


def write_bucketed(df: DataFrame, root: str, layer: str, name: str, keys: list[str] = WINDOW_KEYS,
                   n_buckets: int = 64, prefix: str = "surveil") -> str:
    """Write a layer table bucketed and sorted by ``keys`` (external table under ``root``).

    Tables written with the same keys and bucket count join without a shuffle on either
    side (storage-partitioned join), e.g. gold windows with label windows or alerts."""
    if layer not in NAMESPACES:
        raise ValueError(f"unknown layer {layer!r}")
    spark = df.sparkSession
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {prefix}_{layer}")
    table = f"{prefix}_{layer}.{name}"
    (df.write.mode("overwrite").format("parquet").option("path", f"{root.rstrip('/')}/{layer}/{name}")
     .bucketBy(n_buckets, *keys).sortBy(*keys).saveAsTable(table))
    return table
