"""The medallion as Structured Streaming: the same DataFrame -> DataFrame transforms,
plus event-time watermarks where state is kept.

* bronze: unchanged (stateless projection + filter);
* silver: ``dropDuplicatesWithinWatermark`` on the dedup key (state bounded by the
  watermark delay);
* gold: tumbling event-time windows with the single-pass aggregate; the distinct price
  count becomes ``size(collect_set(price))`` (distinct aggregates are not supported on
  streams; the set is bounded by the distinct prices of one window);
* order <-> execution: a stream-stream inner join with watermarks on both sides and an
  interval condition, so join state is purged once the interval closes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveil.operators import bronze as B
from surveil.operators import detectors as D
from surveil.operators import gold as G
from surveil.operators import gold_states as GS
from surveil.operators import silver as S
from surveil.schemas import DEDUP_KEY, DEFAULT_WINDOW_MS


def with_event_time(df: DataFrame, col: str = "transact_time", name: str = "event_ts") -> DataFrame:
    return df.withColumn(name, F.timestamp_millis(F.col(col)))


def stream_silver(raw: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """Streaming bronze -> silver (dedup of bus re-deliveries within the watermark)."""
    b = with_event_time(B.to_bronze(raw)).withWatermark("event_ts", watermark)
    return S.enrich(b.dropDuplicatesWithinWatermark(DEDUP_KEY))


def stream_gold(silver: DataFrame, window_ms: int = DEFAULT_WINDOW_MS) -> DataFrame:
    """Windowed gold features over a watermarked silver stream."""
    g = silver.withColumn("_stc", G.secs_to_close(F.col("transact_time")))
    G.check_window(window_ms)
    aggs = G.aggregate_exprs(F.pmod(F.col("transact_time"), F.lit(window_ms)))
    aggs["distinct_prices"] = F.size(F.collect_set("price")).cast("long")
    w = F.window("event_ts", f"{window_ms} milliseconds")
    agg = (g.groupBy(w.alias("w"), "trader_id", "symbol", "desk", "asset_class")
           .agg(*[e.alias(n) for n, e in aggs.items()])
           .withColumn("window_start", F.unix_millis(F.col("w.start")))
           .drop("w"))
    return G.derive(agg, window_ms)


def stream_states(silver: DataFrame, step_ms: int = DEFAULT_WINDOW_MS) -> DataFrame:
    """Mergeable gold states of a watermarked silver stream, for append mode: fixed-width state, no price set.

    Coarser windows are merged from the written states (``gold_states.to_gold``)."""
    G.check_window(step_ms)
    g = silver.withColumn("_stc", G.secs_to_close(F.col("transact_time")))
    w = F.window("event_ts", f"{step_ms} milliseconds")
    agg = g.groupBy(w.alias("w"), *[k for k in GS.STATE_KEYS if k != "window_start"]) \
        .agg(*[e.alias(n) for n, e in GS.state_exprs().items()])
    return agg.withColumn("window_start", F.unix_millis(F.col("w.start"))).select(*GS.STATE_KEYS, *GS.state_exprs())


def stream_order_exec_join(silver: DataFrame, max_latency_ms: int = 60_000) -> DataFrame:
    """Orders joined to their executions within [order, order + bound].

    Both sides inherit the silver stream's event-time watermark, so the interval
    condition lets Spark purge join state once an order's fill window has passed."""
    o = (silver.filter(F.col("event_kind") == "NEW")
         .select("cl_ord_id", "trader_id", "symbol", "side", F.col("transact_time").alias("order_time"),
                 "order_qty", "price", F.col("event_ts").alias("o_ts")))
    x = (silver.filter(F.col("event_kind") == "EXEC")
         .select(F.col("cl_ord_id").alias("x_cl_ord_id"), F.col("transact_time").alias("exec_time"), "exec_id",
                 "last_qty", "last_px", F.col("event_ts").alias("x_ts")))
    cond = F.expr(f"cl_ord_id = x_cl_ord_id AND x_ts >= o_ts AND x_ts <= o_ts + INTERVAL {max_latency_ms} MILLISECONDS")
    return o.join(x, cond, "inner").select(
        "cl_ord_id", "trader_id", "symbol", "side", "order_time", "exec_time", "exec_id",
        (F.col("exec_time") - F.col("order_time")).alias("fill_latency_ms"),
        "order_qty", "price", "last_qty", "last_px")


def stream_alerts(raw: DataFrame, watermark: str = "10 minutes", window_ms: int = DEFAULT_WINDOW_MS,
                  created_at: int = 0) -> DataFrame:
    """Raw event stream -> alerts. Run it in append mode: a window is judged once, when the watermark
    has passed its end, so an alert agrees with the batch answer over the complete window. (In
    update mode a signal that later events withdraw would already have been emitted.) The
    detectors stay a narrow projection of gold."""
    return D.detect(stream_gold(stream_silver(raw, watermark), window_ms), created_at=created_at)
