"""Event links: cancel -> original order, order -> execution, label -> events.

All are equi-joins on an id with optional range predicates; Catalyst picks the join
strategy, AQE splits a skewed id at runtime.  Nothing is broadcast that grows with
the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _orders(silver: DataFrame) -> DataFrame:
    return silver.filter(F.col("event_kind") == "NEW").select(
        F.col("cl_ord_id").alias("orig_cl_ord_id"), F.col("trader_id").alias("o_trader_id"),
        F.col("symbol").alias("o_symbol"), F.col("transact_time").alias("order_time"),
        F.col("order_qty").alias("o_order_qty"), F.col("price").alias("o_price"),
        F.col("side").alias("o_side"))


def _cancels(silver: DataFrame) -> DataFrame:
    return silver.filter(F.col("event_kind") == "CANCEL").select(
        "cl_ord_id", "orig_cl_ord_id", "trader_id", "symbol", F.col("transact_time").alias("cancel_time"),
        "order_qty", "cancel_reason")


def cancel_link(silver: DataFrame) -> DataFrame:
    """Each cancel with the order it cancels (inner join on orig_cl_ord_id = cl_ord_id)."""
    j = _cancels(silver).join(_orders(silver), "orig_cl_ord_id", "inner")
    return j.select(
        "cl_ord_id", "orig_cl_ord_id", "trader_id", "symbol", "order_time", "cancel_time",
        (F.col("cancel_time") - F.col("order_time")).alias("cancel_latency_ms"),
        "o_order_qty", "o_price", "o_side",
        ((F.col("trader_id") == F.col("o_trader_id")) & (F.col("symbol") == F.col("o_symbol"))).alias("same_owner"))


def orphan_cancels(silver: DataFrame) -> DataFrame:
    """Cancels whose original order is not in the data (left anti join)."""
    return _cancels(silver).join(_orders(silver).select("orig_cl_ord_id"), "orig_cl_ord_id", "left_anti")


def uncancelled_orders(silver: DataFrame, scenario_type: str | None = None) -> DataFrame:
    """NEW orders never cancelled (optionally within one scenario archetype)."""
    o = silver.filter(F.col("event_kind") == "NEW")
    if scenario_type:
        o = o.filter(F.col("scenario_type") == scenario_type)
    c = silver.filter(F.col("event_kind") == "CANCEL").select(F.col("orig_cl_ord_id").alias("cl_ord_id"))
    return o.join(c, "cl_ord_id", "left_anti")


def order_exec_join(silver: DataFrame, max_latency_ms: int = 60_000) -> DataFrame:
    """Orders joined to their executions: same cl_ord_id, fill within [order, order + bound].

    The batch twin of the watermarked stream-stream join in ``surveil.streaming``.
    """
    o = silver.filter(F.col("event_kind") == "NEW").select(
        "cl_ord_id", "trader_id", "symbol", "side", F.col("transact_time").alias("order_time"),
        "order_qty", "price")
    x = silver.filter(F.col("event_kind") == "EXEC").select(
        F.col("cl_ord_id").alias("x_cl_ord_id"), F.col("transact_time").alias("exec_time"), "exec_id",
        "last_qty", "last_px")
    cond = ((o.cl_ord_id == x.x_cl_ord_id) & (x.exec_time >= o.order_time)
            & (x.exec_time <= o.order_time + F.lit(max_latency_ms)))
    return o.join(x, cond, "inner").select(
        "cl_ord_id", "trader_id", "symbol", "side", "order_time", "exec_time", "exec_id",
        (F.col("exec_time") - F.col("order_time")).alias("fill_latency_ms"),
        "order_qty", "price", "last_qty", "last_px")


def label_integrity(labels: DataFrame, raw: DataFrame) -> DataFrame:
    """Per scenario: how many injected ids exist as events (join on scenario + id)."""
    ids = labels.select("scenario_id", "abuse_type",
                        F.explode(F.array_distinct("injected_event_ids")).alias("cl_ord_id"))
    ev = raw.filter(F.col("scenario_id").isNotNull()).select("scenario_id", "cl_ord_id").distinct() \
        .withColumn("_hit", F.lit(1))
    j = ids.join(ev, ["scenario_id", "cl_ord_id"], "left")
    return (j.groupBy("scenario_id", "abuse_type")
            .agg(F.count(F.lit(1)).alias("n_ids"), F.count("_hit").alias("n_found"))
            .withColumn("ok", F.col("n_ids") == F.col("n_found")))


def alert_events(alerts: DataFrame, silver: DataFrame, bucket_ms: int = 3_600_000) -> DataFrame:
    """(alert_id, event) pairs with window_start <= t < window_end, for windows of any length.

    Both sides are keyed by fixed time buckets (an alert by every bucket its window touches), so
    the range condition runs inside an equi-join on (trader, instrument, bucket) and a hot
    window never becomes one giant array; AQE splits a skewed partition at runtime. An alert with
    an empty or reversed window has no events."""
    t = F.col("transact_time")

    def bucket(x):
        return F.floor(x / F.lit(bucket_ms))
    ev = silver.select(F.col("trader_id"), F.col("symbol").alias("instrument"), bucket(t).alias("_bucket"),
                       "cl_ord_id", "msg_type", "transact_time", "exec_id")
    a = (alerts.filter(F.col("window_end") > F.col("window_start"))
         .select("alert_id", "detector", "trader_id", "instrument", "window_start", "window_end",
                 F.explode(F.sequence(bucket(F.col("window_start")), bucket(F.col("window_end") - 1))).alias("_bucket")))
    return (a.join(ev, ["trader_id", "instrument", "_bucket"], "inner")
            .filter((t >= F.col("window_start")) & (t < F.col("window_end")))
            .select("trader_id", "instrument", "window_start", "alert_id", "detector", "cl_ord_id", "msg_type",
                    "transact_time", "exec_id"))
