"""Mergeable gold states: merged windows equal the direct ones, in batch and from a stream."""
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import fix, raw_df
from surveil.operators import bronze as B
from surveil.operators import gold as G
from surveil.operators import gold_states as GS
from surveil.operators import silver as S
from surveil.schemas import RAW_FIX_SCHEMA
from surveil.session import checkpoint_dir, stored
from surveil.streaming import medallion as SM


def _rows(n=400, shift=0):
    r, rows = random.Random(23), []
    for i in range(n):
        kind, px = r.choice(["new", "fill", "cancel"]), r.choice([0.1, 0.2, 0.3, 7.25, 1e-7])
        extra = {"price": px, "last_px": px * 3, "last_qty": r.randint(1, 90)} if kind == "fill" else {"price": px} if kind == "new" else {}
        rows.append(fix(kind, f"o{i}", shift + r.randint(-7_000_000, 7_000_000), side=r.choice("12"), order_qty=r.randint(1, 900),
                        trader_id=r.choice(["a", "b"]), **extra))
    return rows


def _same(got, want):
    return got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_merged_states_equal_direct_gold(spark):
    silver = stored(S.to_silver(B.to_bronze(raw_df(spark, _rows()))).withColumn("n_orders", F.lit("clash")), "silver")
    late = F.pmod(F.xxhash64("cl_ord_id"), F.lit(3)) == 0
    states = stored(GS.to_states(silver.filter(~late)).union(GS.to_states(silver.filter(late))), "states")
    for window in (60_000, 3_600_000, 86_400_000):
        assert _same(GS.to_gold(states, window), G.to_gold(silver, window)), window
    hours = GS.merge(states, 3_600_000)
    assert hours.columns == states.columns
    assert hours.groupBy(*GS.STATE_KEYS).count().filter("count > 1").isEmpty()
    assert _same(GS.to_gold(hours, 86_400_000, 3_600_000), G.to_gold(silver, 86_400_000))
    plan = GS.to_gold(states, 86_400_000)._jdf.queryExecution().executedPlan().toString()
    assert "states-" in plan and "silver-" not in plan and "SortAggregate" not in plan and "CartesianProduct" not in plan


def test_windows_must_divide_and_empty_tables_stay_empty(spark):
    none = S.to_silver(B.to_bronze(raw_df(spark, [])))
    assert GS.to_gold(GS.to_states(none), 120_000).isEmpty()
    with pytest.raises(ValueError):
        GS.to_gold(GS.to_states(none), 90_000)


def test_streamed_states_merge_to_the_batch_answer(spark):
    d = tempfile.mkdtemp(prefix="states-stream-", dir=checkpoint_dir(spark))
    raw = raw_df(spark, _rows(150, 7_200_000))     # a stream's watermark starts at 1970
    raw.write.mode("overwrite").parquet(f"{d}/raw")
    end = raw_df(spark, [fix("new", "end", 90_000_000, trader_id="clock")])       # moves the watermark past the rest
    end.write.mode("append").parquet(f"{d}/raw")
    s = SM.stream_states(SM.stream_silver(spark.readStream.schema(RAW_FIX_SCHEMA).parquet(f"{d}/raw")))
    q = (s.writeStream.outputMode("append").format("parquet").option("path", f"{d}/out")
         .option("checkpointLocation", f"{d}/ck").trigger(availableNow=True).start())
    q.awaitTermination(300)
    got = GS.to_gold(spark.read.schema(s.schema).parquet(f"{d}/out").filter("trader_id != 'clock'"), 86_400_000)
    assert _same(got, G.to_gold(S.to_silver(B.to_bronze(raw)), 86_400_000))
