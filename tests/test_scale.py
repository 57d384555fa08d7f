"""Bounds of the shared steps: rows of a task, columns and passes that a plan shuffles, reads of the medallion."""
import numpy as np
import pytest
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import functions as F

from conftest import SF_SMALL, fix, raw_df
from surveil.operators import bronze as B
from surveil.operators import gold as G
from surveil.operators import merkle as MK
from surveil.operators import scorer as SC
from surveil.operators import silver as S
from surveil.plans import medallion as M
from surveil.plans import queries as Q
from surveil.sources import feed


def test_tasks_behind_spread_hold_a_bounded_number_of_rows(spark):
    n = 20 * feed.TASK_ROWS
    sizes = feed.spread(spark.range(n), "id").groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in sizes) == n and max(r["count"] for r in sizes) < 1.1 * feed.TASK_ROWS
    assert [feed.parts(k, 8) for k in (0, 10, 35_000, 10 ** 6)] == [2, 2, 4, 20]


def _copies():
    """Deliveries of the same event that differ in columns before, at and behind the prices."""
    rows = [fix("fill", "a", 1, last_px=70.0 + i % 2, order_id=f"o{i % 3}", cancel_reason=str(9 - i), account=None if i == 4 else "z") for i in range(6)]
    for r in rows:
        r["exec_id"] = "x"
    return rows + [fix("new", "b", 2), fix("cancel", "c", 3, orig_cl_ord_id="b"), fix("cancel", "c", 3, orig_cl_ord_id="a")]


def test_dedup_of_needed_columns_keeps_the_same_survivors(spark):
    bronze = B.to_bronze(raw_df(spark, _copies()))
    whole, part = S.to_silver(bronze), S.to_silver(bronze, needed=G.INPUT_COLUMNS)
    assert "cancel_reason" not in part.columns and "order_id" in part.columns
    key = lambda df: sorted(df.select(part.columns).collect(), key=str)
    assert key(whole) == key(part) and len(key(part)) == 3
    assert sorted(G.to_gold(whole).collect(), key=str) == sorted(G.to_gold(part).collect(), key=str)
    plan = M.gold(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "cancel_reason" not in plan.split("Exchange hashpartitioning(cl_ord_id")[1].split("SortAggregate")[1].split("\n")[0]


@pytest.mark.parametrize("name", ["alerts_enriched_fixed", "ml_alerts", "ml_scores", "train_cal_split", "conformal_set"])
def test_queries_that_read_windows_repeatedly_read_stored_ones(spark, name):
    read = Q.QUERIES[name](spark, SF_SMALL).inputFiles()
    assert read and not any(f"/{t}.parquet" in f for f in read for t in ("events", "orders"))


def test_calibration_of_counted_pairs_is_that_of_the_rows(spark):
    rows = spark.range(3000).select((F.pmod(F.xxhash64("id"), F.lit(37)) / 37.0).alias("raw_score"),
                                    (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(3)) == 0).cast("int").alias("label"))
    plain = IsotonicRegression(featuresCol="raw_score", labelCol="label", predictionCol="_cal").fit(rows)
    mine = SC.calibrator(rows)
    assert np.allclose(mine.boundaries.toArray(), plain.boundaries.toArray()) and np.allclose(mine.predictions.toArray(), plain.predictions.toArray())
    assert mine.transform(rows.limit(5)).columns[-1] == "_cal"


def test_wanted_nodes_need_few_groups_of_the_tree(spark):
    chain = spark.range(1, 70_001).select((F.col("id") % 2).alias("chain_id"), F.floor((F.col("id") + 1) / 2).cast("long").alias("seq"),
                                          F.sha2(F.col("id").cast("string"), 256).alias("entry_hash"))
    want = spark.createDataFrame([(1, 0, 5), (1, 7, 3), (1, 8, 0), (1, 8, 130), (0, 3, 4000), (0, 15, 0)], "chain_id long, level int, index long")
    key = ["chain_id", "level", "index"]
    whole, few = MK.nodes(chain).cache(), MK.nodes(chain, want).cache()
    got = lambda t: sorted(map(tuple, t.join(want, key).select(*key, "hash").collect()))
    assert got(whole) == got(few) and len(got(few)) == 6
    assert few.count() < whole.count() / 50


def test_pattern_lookup_gives_the_summed_attributions(monkeypatch):
    rng = np.random.default_rng(3)
    n, d, nf = 40, 4, 6
    m = rng.integers(0, d + 1, n)
    feat, lo, hi, z = -np.ones((n, d), int), np.full((n, d), -np.inf), np.full((n, d), np.inf), np.ones((n, d))
    for i in range(n):
        feat[i, :m[i]] = np.sort(rng.choice(nf, m[i], replace=False))
        lo[i, :m[i]], z[i, :m[i]] = rng.random(m[i]), rng.random(m[i])
    leaves, X = SC.Leaves(rng.normal(size=n), m, feat, lo, hi, z), rng.random((200, nf))
    X[0] = np.nan
    fast = SC.tree_shap(X, leaves, nf)
    monkeypatch.setattr(SC, "PATTERN_BITS", 0)
    assert np.allclose(fast, SC.tree_shap(X, leaves, nf), rtol=1e-12, atol=1e-12)
