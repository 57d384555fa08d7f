"""Hot keys: a third of all rows in one dedup group / one gold window / one join key."""
from pyspark.sql import functions as F

from surveil.operators import bronze as B
from surveil.operators import gold as G
from surveil.operators import links as L
from surveil.operators import silver as S
from surveil.schemas import RAW_FIX_FIELDS


def _raw(spark, n=30_000):
    """n events; every third row is a re-delivery of one hot event, and half of the rest
    fall into one hot (trader, symbol, minute) window."""
    i = F.col("id")
    hot_copy = F.pmod(i, F.lit(3)) == 0
    hot_window = F.pmod(i, F.lit(2)) == 0
    cols = {
        "msg_type": F.when(hot_copy, F.lit("D")).otherwise(F.element_at(F.array(*[F.lit(m) for m in "D8F"]),
                                                                         (F.pmod(i, F.lit(3)) + 1).cast("int"))),
        "cl_ord_id": F.when(hot_copy, F.lit("hot")).otherwise(F.concat(F.lit("o"), i.cast("string"))),
        "trader_id": F.when(hot_copy | hot_window, F.lit("T-HOT")).otherwise(F.concat(F.lit("T-"), (i % 97).cast("string"))),
        "account": F.lit("ACC"), "symbol": F.lit("RY"),
        "side": F.when(F.pmod(i, F.lit(4)) < 2, F.lit("1")).otherwise(F.lit("2")),
        "order_qty": F.lit(100).cast("long"), "ord_type": F.lit("2"),
        "transact_time": F.when(hot_copy, F.lit(5)).when(hot_window, i % 60_000).otherwise(i * 1000),
        "exchange_id": F.lit("TSX"),
        "price": F.when(F.pmod(i, F.lit(3)) == 2, F.lit(None)).otherwise((F.lit(14000) + i % 7).cast("double") / 100.0),
        "exec_id": F.when(F.pmod(i, F.lit(3)) == 1, F.concat(F.lit("e"), i.cast("string"))),
        "last_qty": F.when(F.pmod(i, F.lit(3)) == 1, F.lit(100).cast("long")),
        "last_px": F.when(F.pmod(i, F.lit(3)) == 1, (F.lit(14000) + i % 7).cast("double") / 100.0),
        "orig_cl_ord_id": F.when(F.pmod(i, F.lit(3)) == 2, F.lit("hot")),
    }
    return spark.range(n).repartition(8).select(
        *[cols.get(c, F.lit(None)).cast(t).alias(c) for c, t in RAW_FIX_FIELDS])


def test_hot_group_of_copies_collapses_before_the_shuffle(spark):
    raw = _raw(spark)
    silver = S.to_silver(B.to_bronze(raw))
    assert silver.filter(F.col("cl_ord_id") == "hot").count() == 1
    assert silver.count() == 30_000 - 10_000 + 1
    plan = silver._jdf.queryExecution().executedPlan().toString()
    below = plan.split("Exchange hashpartitioning(cl_ord_id")[1]
    assert "partial_min" in below  # map-side partial aggregation under the dedup shuffle


def test_hot_window_gold_matches_direct_counts(spark):
    silver = S.to_silver(B.to_bronze(_raw(spark))).cache()
    gold = G.to_gold(silver)
    hot = gold.filter((F.col("trader_id") == "T-HOT") & (F.col("window_start") == 0)).first()
    want = silver.filter((F.col("trader_id") == "T-HOT") & (F.col("transact_time") < 60_000)).agg(
        F.sum(F.when(F.col("msg_type") == "D", 1).otherwise(0)).alias("n_orders"),
        F.sum(F.when(F.col("msg_type") == "F", 1).otherwise(0)).alias("n_cancels"),
        F.countDistinct("price").alias("distinct_prices")).first()
    assert (hot["n_orders"], hot["n_cancels"], hot["distinct_prices"]) == \
        (want["n_orders"], want["n_cancels"], want["distinct_prices"])
    plan = gold._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan.split("Exchange hashpartitioning(trader_id")[-1]


def test_hot_join_key_cancel_link(spark):
    silver = S.to_silver(B.to_bronze(_raw(spark)))
    n_cancels = silver.filter(F.col("event_kind") == "CANCEL").count()
    assert L.cancel_link(silver).count() == n_cancels  # every cancel points at the one hot order
    assert L.orphan_cancels(silver).count() == 0
