"""Sources and sinks: JSON ingest, namespaces / layer tables, time-ordered files, lineage."""
import datetime
import json
import tempfile

from pyspark.sql import functions as F

from conftest import SF_SMALL, fix
from surveil.operators import audit as AU
from surveil.operators import bronze as B
from surveil.plans import medallion as M
from surveil.sources import catalog, raw as R


def _scratch(spark):
    from surveil.session import checkpoint_dir
    return tempfile.mkdtemp(prefix="src-", dir=checkpoint_dir(spark))


def test_json_lines_are_read_into_the_fixed_schema(spark):
    d = _scratch(spark)
    with open(f"{d}/ev.json", "w") as f:
        for row in (fix("new", "whole", 11, price=8, note="dropped"), fix("fill", "whole", 12),
                    {"cl_ord_id": "torn", "msg_type": "D", "price": "eight"}):
            f.write(json.dumps(row) + "\n")
    df = R.read_json(spark, f"{d}/ev.json")
    rows = {(r.cl_ord_id, r.msg_type): r for r in df.collect()}
    assert "note" not in df.columns and len(rows) == 3
    assert rows["whole", "D"].price == 8.0 and rows["whole", "D"].exec_type is None
    assert rows["whole", "8"].last_px == 71.25 and rows["torn", "D"].price is None
    assert [r.cl_ord_id for r in B.bronze_quarantine(df).collect()] == ["torn"]


def test_namespaces_and_layer_table_with_partition_pruning(spark):
    d = _scratch(spark)
    names = catalog.ensure_namespaces(spark, prefix="t")
    assert len(names) == 7
    silver = M.silver(spark, SF_SMALL)
    table = catalog.write_layer(silver, d, "silver", "events", prefix="t", granularity="month")
    back = spark.table(table)
    assert back.count() == silver.count()
    day = back.select("event_date").orderBy("event_date").first()["event_date"]
    plan = back.filter(F.col("event_date") == F.lit(day))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "event_date" in plan


def test_time_ordered_files(spark):
    d = _scratch(spark)
    catalog.write_time_ordered(M.raw(spark, SF_SMALL), f"{d}/ordered", n_files=4)
    parts = spark.read.parquet(f"{d}/ordered").withColumn("f", F.input_file_name())
    bounds = parts.groupBy("f").agg(F.min("transact_time").alias("lo"), F.max("transact_time").alias("hi")) \
        .orderBy("lo").collect()
    assert all(a["hi"] <= b["lo"] for a, b in zip(bounds, bounds[1:]))


def test_lineage_entries_chain_and_verify(spark):
    e = AU.table_written_entries(spark, [("surveil_silver.events", "/x/silver/events", 123, 1000),
                                         ("surveil_gold.windows", "/x/gold/windows", 45, 1001)])
    chain = AU.append(AU.assign_chains(e, n_chains=1))
    assert [r["verified"] for r in AU.verify(chain).collect()] == [True]


def test_bucketed_layers_join_without_shuffle(spark):
    from surveil.operators import labels as LB
    from surveil.sources import feed
    d = _scratch(spark)
    gold = M.gold(spark, SF_SMALL)
    lw = LB.label_windows(feed.labels(spark, SF_SMALL), with_type=False).withColumn("label", F.lit(1))
    g = catalog.write_bucketed(gold, d, "gold", "windows", n_buckets=8, prefix="tb")
    lt = catalog.write_bucketed(lw, d, "gold", "label_windows", n_buckets=8, prefix="tb")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        j = spark.table(g).join(spark.table(lt), catalog.WINDOW_KEYS, "left")
        plan = j._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        assert j.filter(F.col("label") == 1).count() == LB.labelled_windows(gold, feed.labels(spark, SF_SMALL)) \
            .filter(F.col("label") == 1).count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_batch_job_writes_every_layer_and_matches_lazy_plans(spark):
    from surveil.plans import batch
    d = _scratch(spark)
    t = batch.run(spark, SF_SMALL, d, prefix="bj", granularity="month")  # sparse multi-year fixture
    assert spark.table(t["events"]).count() == M.silver(spark, SF_SMALL).count()
    stored = spark.table(t["alerts"]).drop("event_date")
    lazy = M.alerts(spark, SF_SMALL)
    assert stored.count() == lazy.count()
    assert stored.select("alert_id", "audit_hash").exceptAll(lazy.select("alert_id", "audit_hash")).count() == 0
    from surveil.operators import audit as AU
    chain = spark.table(t["audit_chain"])
    assert all(r["verified"] for r in AU.verify(chain, spark.table(t["audit_anchors"])).collect())
    lineage = spark.table(t["lineage_chain"])
    assert lineage.count() == 7 and all(r["verified"] for r in AU.verify(lineage).collect())


def test_records_give_the_same_rows_as_json(spark):
    rows = [fix("new", "whole", 11, price=8, note="dropped"), {"cl_ord_id": "torn", "msg_type": "D"}]
    df = R.from_records(spark, rows)
    assert [(r.cl_ord_id, r.price) for r in B.to_bronze(df).collect()] == [("whole", 8.0)]
    assert [r.cl_ord_id for r in B.bronze_quarantine(df).collect()] == ["torn"]


def test_second_daily_run_leaves_earlier_days_untouched(spark):
    from surveil.plans import batch
    d = _scratch(spark)
    days = [r.d for r in M.silver(spark, SF_SMALL).groupBy(catalog.event_date("transact_time").alias("d")).count()
            .orderBy(F.desc("count"), "d").limit(2).collect()]
    names = [(str(x), str(x + datetime.timedelta(days=1))) for x in sorted(days)]
    t = batch.run(spark, SF_SMALL, d, prefix="bd", days=names[0])

    def files():
        return {r.f: r.t for r in spark.read.parquet(f"{d}/silver/events").select(F.input_file_name().alias("f"),
                F.col("_metadata.file_modification_time").alias("t")).distinct().collect()}
    first = files()
    batch.run(spark, SF_SMALL, d, prefix="bd", days=names[1])
    both = files()
    assert first.items() <= both.items() and len(both) > len(first)
    lazy = M.silver(spark, SF_SMALL).filter(catalog.event_date("transact_time").isin(*days))
    assert spark.table(t["events"]).count() == lazy.count()


def test_batch_job_with_scoring_appends_ml_entries_to_the_chain(spark):
    from surveil.operators import audit as AU
    from surveil.plans import batch
    d = _scratch(spark)
    t = batch.run(spark, SF_SMALL, d, prefix="bs", granularity="month", score=True, ml_max_iter=10)
    scored = spark.table(t["alerts_scored"])
    assert scored.filter(F.col("ml_score").isNull()).count() == 0
    chain = spark.table(t["audit_chain"])
    n_alerts = spark.table(t["alerts"]).count()
    assert chain.count() == 2 * n_alerts
    assert chain.filter(F.col("action") == "ML_SCORED").count() == n_alerts
    assert all(r["verified"] for r in AU.verify(chain, spark.table(t["audit_anchors"])).collect())
