"""Keyed running total: the stateful streaming operator and its batch equivalent.

Stream: ``groupBy(key).transformWithStateInPandas`` keeps one ValueState<long> per key
(RocksDB state store), emits the new total per key in Update mode, and survives
restarts through the checkpoint.  Batch: the same totals per micro-batch period,
pre-aggregated per (key, period) before the running sum, so a hot key costs one row
per period, not one row per event.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

OUTPUT_SCHEMA = StructType([StructField("instrument", StringType()), StructField("running", LongType())])


def running_qty_batch(silver: DataFrame, period_ms: int = 86_400_000) -> DataFrame:
    """instrument, batch_day, qty of NEW orders in the period, running total."""
    t = F.col("transact_time")
    per = (silver.filter(F.col("event_kind") == "NEW")
           .groupBy(F.col("symbol").alias("instrument"), (t - F.pmod(t, F.lit(period_ms))).alias("batch_day"))
           .agg(F.sum("order_qty").alias("qty")))
    w = Window.partitionBy("instrument").orderBy("batch_day").rowsBetween(Window.unboundedPreceding,
                                                                          Window.currentRow)
    return per.withColumn("running", F.sum("qty").over(w))


class RunningQtyProcessor(StatefulProcessor):
    """Per-key running sum of ``qty`` in a ValueState (no TTL)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.total = handle.getValueState("total", StructType([StructField("v", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        s = self.total.get()[0] if self.total.exists() else 0
        for pdf in rows:
            s += int(pdf["qty"].sum())
        self.total.update((s,))
        yield pd.DataFrame({"instrument": [key[0]], "running": [s]})

    def close(self) -> None:
        pass


def _partial_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per instrument and Arrow batch: what a hot instrument sends to its state's task."""
    for pdf in batches:
        yield pdf.groupby("instrument", as_index=False, dropna=False)["qty"].sum()


def running_qty_stream(orders: DataFrame) -> DataFrame:
    """Streaming (instrument, qty) -> (instrument, running) in Update mode.

    Quantities are summed inside each input task before the shuffle, so a hot instrument's state
    task receives a row per input batch, not a row per order. Null quantities count as 0."""
    orders = orders.select("instrument", F.coalesce(F.col("qty").cast("long"), F.lit(0).cast("long")).alias("qty"))
    return (orders.mapInPandas(_partial_sums, "instrument string, qty long").groupBy("instrument")
            .transformWithStateInPandas(RunningQtyProcessor(), OUTPUT_SCHEMA, "Update", "None"))


def write_updates(path: str):
    """foreachBatch sink: append each micro-batch of updates, tagged with its batch id.

    Re-running a batch after a failure rewrites that batch id's folder (idempotent)."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    return sink
