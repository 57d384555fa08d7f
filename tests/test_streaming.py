"""Structured Streaming: state across micro-batches and restarts, batch == stream."""
import tempfile
import time

from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from conftest import SF_SMALL, fix, raw_df
from surveil.operators import links as L
from surveil.operators import audit as AU
from surveil.plans import medallion as M
from surveil.schemas import RAW_FIX_SCHEMA
from surveil.streaming import medallion as SM
from surveil.streaming import audit_stream, running


def _scratch(spark):
    from surveil.session import checkpoint_dir
    return tempfile.mkdtemp(prefix="stream-", dir=checkpoint_dir(spark))


def test_running_total_state_survives_restart(spark):
    d = _scratch(spark)
    src, out, ckpt = f"{d}/in", f"{d}/out", f"{d}/ckpt"
    schema = "instrument string, qty long"

    def run():
        s = spark.readStream.schema(schema + ", b int").parquet(src)
        q = (running.running_qty_stream(s).writeStream.outputMode("update")
             .option("checkpointLocation", ckpt).foreachBatch(running.write_updates(out))
             .trigger(availableNow=True).start())
        q.awaitTermination(120)

    rows = [("XQZ", 40 + i) for i in range(50)] + [("ABC", 7), ("ABC", None)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{src}/b=1")
    run()
    first = {r["instrument"]: r["running"] for r in spark.read.parquet(out).collect()}
    assert first == {"XQZ": sum(q for _, q in rows[:50]), "ABC": 7}
    spark.createDataFrame([("XQZ", -1000)], schema).coalesce(1).write.parquet(f"{src}/b=2")
    run()  # new query instance, same checkpoint: state is restored
    latest = spark.read.parquet(out).groupBy("instrument").agg(F.max_by("running", "batch_id").alias("r"))
    assert {r["instrument"]: r["r"] for r in latest.collect()} == {"XQZ": first["XQZ"] - 1000, "ABC": 7}


def _stream_raw(spark):
    d = _scratch(spark)
    M.raw(spark, SF_SMALL).repartition(4).write.parquet(f"{d}/raw")
    return spark.readStream.schema(RAW_FIX_SCHEMA).parquet(f"{d}/raw"), d


def _drain(df, mode, d, name):
    q = (df.writeStream.outputMode(mode).format("memory").queryName(name)
         .option("checkpointLocation", f"{d}/ck-{name}").trigger(availableNow=True).start())
    q.awaitTermination(300)
    return df.sparkSession.table(name)


def test_streamed_gold_equals_batch_gold(spark):
    raw, d = _stream_raw(spark)
    got = _drain(SM.stream_gold(SM.stream_silver(raw)), "update", d, "gold_stream")
    want = M.gold(spark, SF_SMALL)
    cols = want.columns
    assert got.count() == want.count()
    assert got.select(*cols).exceptAll(want.select(*cols)).count() == 0


def test_stream_dedup_drops_redeliveries(spark):
    raw, d = _stream_raw(spark)
    got = _drain(SM.stream_silver(raw).drop("event_ts"), "append", d, "silver_stream")
    assert got.count() == M.silver(spark, SF_SMALL).count()


def test_stream_stream_order_exec_join_equals_batch(spark):
    raw, d = _stream_raw(spark)
    got = _drain(SM.stream_order_exec_join(SM.stream_silver(raw)), "append", d, "oex_stream")
    want = L.order_exec_join(M.silver(spark, SF_SMALL), 60_000)
    assert got.count() == want.count()
    assert got.exceptAll(want.select(*got.columns)).count() == 0


def test_streaming_chain_append_continues_across_batches(spark):
    from surveil.operators import audit as AU
    d = _scratch(spark)
    schema = "subsystem string, action string, ref_id string, ts long, payload array<string>"
    rows = [("ml", "ML_SCORED", f"r{i:03d}", 100 + i, [str(i)]) for i in range(30)]
    spark.createDataFrame(rows[:18], schema).coalesce(1).write.parquet(f"{d}/in/b=1")

    def run():
        s = spark.readStream.schema(schema + ", b int").parquet(f"{d}/in").drop("b")
        q = (audit_stream.append_stream(s, n_chains=3).writeStream.outputMode("append")
             .option("checkpointLocation", f"{d}/ck").foreachBatch(running.write_updates(f"{d}/out"))
             .trigger(availableNow=True).start())
        q.awaitTermination(120)

    run()
    spark.createDataFrame(rows[18:], schema).coalesce(1).write.parquet(f"{d}/in/b=2")
    run()
    got = spark.read.parquet(f"{d}/out").select("chain_id", "seq", "ref_id", "prev_hash", "entry_hash")
    batch = AU.append(AU.assign_chains(spark.createDataFrame(rows, schema), n_chains=3)) \
        .select("chain_id", "seq", "ref_id", "prev_hash", "entry_hash")
    assert got.count() == 30
    assert got.exceptAll(batch).count() == 0


def test_stream_takes_over_a_batch_log(spark):
    """Batch, then stream, then verify: the streamed entries go on from the anchored heads, also after a restart."""
    d = _scratch(spark)
    schema = "subsystem string, action string, ref_id string, ts long, payload array<string>"
    rows = [("pipeline", "TABLE_WRITTEN", f"ref-{i:03d}", 1000 + i, [f"p{i}", None]) for i in range(45)]
    batch = AU.append(AU.assign_chains(spark.createDataFrame(rows[:20], schema), n_chains=5))
    batch.write.parquet(f"{d}/log")
    AU.anchor(spark.read.parquet(f"{d}/log"), 5).write.parquet(f"{d}/anchors")

    def run():
        s = spark.readStream.schema(schema + ", b int").parquet(f"{d}/in").drop("b")
        q = (audit_stream.append_stream(s, anchors=spark.read.parquet(f"{d}/anchors")).writeStream.outputMode("append")
             .option("checkpointLocation", f"{d}/ck").foreachBatch(running.write_updates(f"{d}/out")).trigger(availableNow=True).start())
        q.awaitTermination(120)
    for b, part in enumerate((rows[20:33], rows[33:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{d}/in/b={b}")
        run()
    whole = spark.read.parquet(f"{d}/log").unionByName(spark.read.parquet(f"{d}/out").select(*AU.CHAIN_COLUMNS))
    report = AU.verify(whole, spark.read.parquet(f"{d}/anchors")).collect()
    assert all(r.verified for r in report) and sum(r.n_entries for r in report) == 45
    at_once = AU.append(AU.assign_chains(spark.createDataFrame(rows, schema), n_chains=5))
    assert whole.exceptAll(at_once.select(*AU.CHAIN_COLUMNS)).count() == 0


FAR = 4_102_444_800_000        # an event this late moves the watermark past every window


def _far(spark):
    return raw_df(spark, [fix("new", "far", FAR, trader_id="tr-far")])


def test_streamed_alerts_equal_batch_alerts(spark):
    d = _scratch(spark)
    M.raw(spark, SF_SMALL).unionByName(_far(spark)).repartition(4).write.parquet(f"{d}/raw")
    raw = spark.readStream.schema(RAW_FIX_SCHEMA).parquet(f"{d}/raw")
    got = _drain(SM.stream_alerts(raw).drop("shap_top_features"), "append", d, "alerts_stream")
    want = M.alerts(spark, SF_SMALL).drop("shap_top_features")
    assert got.count() == want.count()
    assert got.exceptAll(want).count() == 0


def test_signal_withdrawn_in_a_later_batch_is_never_emitted(spark):
    """Window 0 looks like spoofing after the first batch; the second batch's fills withdraw it. A second
    trader's signal stands. One file, and so one micro-batch, at a time."""
    from surveil.operators import bronze as B
    from surveil.operators import detectors as D
    from surveil.operators import gold as G
    from surveil.operators import silver as S
    d = _scratch(spark)
    batches = [
        [fix("new", f"n{t}{i}", 1000 + i, trader_id=t) for t in "ab" for i in range(5)]
        + [fix("cancel", f"c{t}{i}", 2000 + i, trader_id=t) for t in "ab" for i in range(4)],
        [fix("new", f"m{i}", 3000 + i, trader_id="a") for i in range(40)] + [fix("fill", f"m{i}", 4000 + i, trader_id="a") for i in range(40)],
    ]
    parts = [raw_df(spark, rows) for rows in batches] + [_far(spark)]

    def alerts(df):
        return {(r.trader_id, r.detector) for r in D.detect(G.to_gold(S.to_silver(B.to_bronze(df)))).collect() if r.trader_id != "tr-far"}
    early, final = alerts(parts[0]), alerts(parts[0].unionByName(parts[1]))
    assert early > final and final
    for i, p in enumerate(parts):
        p.coalesce(1).write.parquet(f"{d}/in/b={i}")
        time.sleep(1.1)                                   # files are taken in order of their times
    schema = StructType(RAW_FIX_SCHEMA.fields + [StructField("b", IntegerType())])
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/in").drop("b")
    got = _drain(SM.stream_alerts(raw).drop("shap_top_features"), "append", d, "withdrawn")
    assert {(r.trader_id, r.detector) for r in got.collect()} == final


def test_late_events_beyond_the_watermark_are_dropped(spark):
    d = _scratch(spark)
    hour = 3_600_000
    first = [fix("new", f"a{i}", hour + i * 1000) for i in range(5)]
    second = [fix("new", "late", hour - 20 * 60_000), fix("new", "in time", hour + 30_000)]
    raw_df(spark, first).coalesce(1).write.parquet(f"{d}/in/b=1")

    def run():
        schema = StructType(RAW_FIX_SCHEMA.fields + [StructField("b", IntegerType())])
        s = spark.readStream.schema(schema).parquet(f"{d}/in").drop("b")
        q = (SM.stream_gold(SM.stream_silver(s, "10 minutes")).writeStream.outputMode("update")
             .option("checkpointLocation", f"{d}/ck").foreachBatch(running.write_updates(f"{d}/out"))
             .trigger(availableNow=True).start())
        q.awaitTermination(120)

    run()
    raw_df(spark, second).coalesce(1).write.parquet(f"{d}/in/b=2")
    run()
    latest = spark.read.parquet(f"{d}/out").groupBy("window_start").agg(F.max("n_orders").alias("n"))
    assert {r["window_start"]: r["n"] for r in latest.collect()} == {hour: 6}


def test_json_value_stream_to_alerts_equals_batch(spark):
    """The Kafka path offline: a stream of JSON strings in a `value` column (a text
    source has the same shape as a Kafka value) parsed by from_json_column."""
    from surveil.sources import raw as R
    d = _scratch(spark)
    R.to_event_json(M.raw(spark, SF_SMALL).unionByName(_far(spark))).select("event_json").repartition(4).write.text(f"{d}/json")
    stream = R.from_json_column(spark.readStream.text(f"{d}/json"), "value")
    got = _drain(SM.stream_alerts(stream).drop("shap_top_features"), "append", d, "json_alerts")
    want = M.alerts(spark, SF_SMALL).drop("shap_top_features")
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_feed_adapter_runs_on_streams(spark):
    from surveil.sources import dims, feed
    d = _scratch(spark)
    spark.read.parquet(f"{SF_SMALL}/orders.parquet").write.parquet(f"{d}/orders")
    orders = spark.readStream.schema(spark.read.parquet(f"{d}/orders").schema).parquet(f"{d}/orders")
    sc = feed.scenario_events(feed.scenario_params(orders), dims.templates(spark))
    got = _drain(sc, "append", d, "scen_stream")
    (batch_orders,) = feed.read_tables(spark, SF_SMALL, "orders")
    assert got.count() == feed.scenario_events(feed.scenario_params(batch_orders), dims.templates(spark)).count()
