"""Feed adapter: derive FIX-shaped events from the driver tables.

* ``events`` becomes benign order flow (one FIX event per row, some re-delivered twice,
  some with a missing symbol so the quarantine path is exercised);
* every ``orders`` row becomes the parameters of one labelled abuse scenario, expanded
  into events by one broadcast join with the fixed template table.

Source rows are dealt out by key first (``spread``); from there both paths are narrow (projection,
explode, broadcast join with a fixed table).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from surveil.schemas import CLOSE_MS_OF_DAY, RAW_FIX_FIELDS, RAW_FIX_SCHEMA
from surveil.sources import dims

_EXCHANGE = dims.INSTRUMENTS[0][1]


def _symbols() -> Column:
    return F.array(*[F.lit(s) for s, _, _, _ in dims.INSTRUMENTS])


def _mids() -> Column:
    return F.array(*[F.lit(m) for _, _, m, _ in dims.INSTRUMENTS])


def _archetypes() -> Column:
    return F.array(*[F.lit(a) for a in dims.ARCHETYPES])

# Mapping parameters of the benign adapter.
BENIGN_MSG = [("click", "D"), ("view", "D"), ("purchase", "8"), ("error", "F"), ("signup", "G")]
NULL_SYMBOL_EVERY = 50      # props.k multiple of this -> symbol NULL (quarantined)
REDELIVER_EVERY = 10        # event_id multiple of this -> emitted twice (deduplicated)
SCENARIO_MINUTES = 900      # scenario start spread over this many minutes of the order day
MTC_LEAD_MS = 50_000        # marking-the-close starts this long before the close

TASK_ROWS = 50_000          # source rows dealt to one task: some 400,000 events
MIN_TASK_ROWS = 10_000      # not spread thinner than this


def _ms(df: DataFrame, col: str) -> Column:
    """Epoch milliseconds (floor) of a timestamp column, independent of the session time zone.

    timestamp_ntz is a wall-clock value read as UTC (micros since the NTZ epoch); a
    timestamp (instant) is converted directly."""
    if isinstance(df.schema[col].dataType, TimestampNTZType):
        us = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{col}`)")
    else:
        us = F.unix_micros(F.col(col).cast("timestamp"))
    return ((us - F.pmod(us, F.lit(1000))) / F.lit(1000)).cast("long")


def _price(mid_cents: Column, ticks: Column) -> Column:
    return (mid_cents + ticks).cast("double") / F.lit(100.0)


def _raw(cols: dict[str, Column]) -> list[Column]:
    """Project to RAW_FIX_SCHEMA order and types, NULL for absent fields."""
    return [cols.get(n, F.lit(None)).cast(t).alias(n) for n, t in RAW_FIX_FIELDS]


def benign_events(events: DataFrame) -> DataFrame:
    """events(event_id, ts, user_id, event_type, props{k}) -> raw FIX rows."""
    e = events.select("event_id", "ts", "user_id", "event_type", "props")
    k = F.get_json_object(F.col("props"), "$.k").try_cast("long")
    eid = F.col("event_id")
    msg = F.lit(None).cast("string")
    for et, m in reversed(BENIGN_MSG):
        msg = F.when(F.col("event_type") == et, F.lit(m)).otherwise(msg)
    sym_idx = F.pmod(k, F.lit(len(dims.INSTRUMENTS)))
    symbol = F.when(F.pmod(k, F.lit(NULL_SYMBOL_EVERY)) != 0, F.element_at(_symbols(), (sym_idx + 1).cast("int")))
    mid = F.element_at(_mids(), (sym_idx + 1).cast("int"))
    price = _price(mid, F.pmod(k, F.lit(11)) - 5)
    trader = F.concat(F.lit("T-"), F.lpad(F.pmod(F.col("user_id"), F.lit(dims.N_BENIGN_TRADERS)).cast("string"), 3, "0"))
    qty = (F.pmod(eid, F.lit(20)) + 1) * 100
    is_exec, is_cancel = msg == "8", msg == "F"
    cols = {
        "msg_type": msg,
        "cl_ord_id": F.concat(F.lit("n-"), eid.cast("string")),
        "trader_id": trader,
        "account": F.concat(F.lit("ACC-"), trader),
        "symbol": symbol,
        "side": F.when(F.pmod(eid, F.lit(2)) == 0, F.lit("1")).otherwise(F.lit("2")),
        "order_qty": qty,
        "ord_type": F.lit("2"),
        "transact_time": _ms(events, "ts"),
        "exchange_id": F.lit(_EXCHANGE),
        "price": F.when(~is_cancel, price),
        "exec_type": F.when(is_exec, F.lit("2")),
        "exec_id": F.when(is_exec, F.concat(F.lit("e-"), eid.cast("string"))),
        "last_qty": F.when(is_exec, qty),
        "last_px": F.when(is_exec, price),
        "orig_cl_ord_id": F.when(is_cancel, F.concat(F.lit("n-"), (eid - 1).cast("string"))),
    }
    copies = F.when(F.pmod(eid, F.lit(REDELIVER_EVERY)) == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return e.withColumn("_copy", F.explode(copies)).select(*_raw(cols))


def scenario_params(orders: DataFrame) -> DataFrame:
    """One scenario per order: id, archetype, abuser, instrument and start time t0."""
    ok, ck = F.col("o_orderkey"), F.col("o_custkey")
    archetype = F.element_at(_archetypes(), (F.pmod(ok, F.lit(len(dims.ARCHETYPES))) + 1).cast("int"))
    sym_idx = (F.pmod(ck, F.lit(len(dims.INSTRUMENTS))) + 1).cast("int")
    trader = F.concat(F.lit("A-"), F.lpad(F.pmod(ck, F.lit(dims.N_ABUSIVE_TRADERS)).cast("string"), 3, "0"))
    day = _ms(orders, "o_orderdate")
    t0 = F.when(archetype == "MARKING_THE_CLOSE", day + F.lit(CLOSE_MS_OF_DAY - MTC_LEAD_MS)) \
        .otherwise(day + F.pmod(ok * 7, F.lit(SCENARIO_MINUTES)) * 60_000)
    return orders.select(
        F.concat(F.lit("sc-"), ok.cast("string")).alias("scenario_id"),
        archetype.alias("archetype"),
        trader.alias("abuser_id"),
        F.concat(F.lit("ACC-"), trader).alias("abuser_account"),
        F.element_at(_symbols(), sym_idx).alias("symbol"),
        F.element_at(_mids(), sym_idx).alias("mid_cents"),
        t0.cast("long").alias("t0"),
    )


def scenario_events(params: DataFrame, templates: DataFrame) -> DataFrame:
    """params x broadcast(templates) -> raw FIX rows (one per template step)."""
    j = params.join(F.broadcast(templates), "archetype")
    sid = F.col("scenario_id")

    def sfx(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.concat(sid, F.lit("-"), F.col(c)))

    client = F.col("who") == "C"
    is_exec = F.col("t_msg") == "8"
    price = F.when(F.col("ticks").isNotNull(), _price(F.col("mid_cents"), F.col("ticks")))
    cols = {
        "msg_type": F.col("t_msg"),
        "cl_ord_id": sfx("sfx"),
        "trader_id": F.when(client, F.concat(sid, F.lit("-client"))).otherwise(F.col("abuser_id")),
        "account": F.when(client, F.concat(sid, F.lit("-client-acc"))).otherwise(F.col("abuser_account")),
        "symbol": F.col("symbol"),
        "side": F.col("t_side"),
        "order_qty": F.col("t_qty"),
        "ord_type": F.col("t_ord_type"),
        "transact_time": F.col("t0") + F.col("dt"),
        "exchange_id": F.lit(_EXCHANGE),
        "price": price,
        "exec_type": F.when(is_exec, F.lit("2")),
        "order_id": sfx("oid_sfx"),
        "exec_id": sfx("eid_sfx"),
        "last_qty": F.when(is_exec, F.col("t_qty")),
        "last_px": F.when(is_exec, price),
        "orig_cl_ord_id": sfx("orig_sfx"),
        "cancel_reason": F.col("reason"),
        "scenario_id": sid,
        "scenario_type": F.col("archetype"),
    }
    return j.select(*_raw(cols))


def scenario_labels(params: DataFrame, label_templates: DataFrame) -> DataFrame:
    """Ground-truth label per scenario; a narrow projection, no grouping."""
    j = params.join(F.broadcast(label_templates), "archetype")
    sid = F.col("scenario_id")
    return j.select(
        sid,
        F.col("archetype").alias("abuse_type"),
        F.col("abuser_id").alias("trader_id"),
        F.col("symbol").alias("instrument"),
        F.col("t0").alias("window_start"),
        (F.col("t0") + F.col("end_dt")).alias("window_end"),
        F.transform("id_sfx", lambda s: F.concat(sid, F.lit("-"), s)).alias("injected_event_ids"),
    )


def read_tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir.rstrip('/')}/{n}.parquet") for n in names]


def parts(n_rows: int, cores: int) -> int:
    """Tasks for ``n_rows`` source rows: at most ``TASK_ROWS`` in one, all cores busy unless there are few rows.

    Two at least: a single partition would meet every later grouping, and all of it would run in that one task."""
    return max(2, -(-n_rows // TASK_ROWS), min(cores, -(-n_rows // MIN_TASK_ROWS)))


def spread(table: DataFrame, key: str) -> DataFrame:
    """Deal the source rows out by their unique key, at every size.

    A row becomes up to twelve wide FIX events and everything up to the dedup's sort runs in the tasks behind this
    exchange. It moves the narrow source rows: about a twentieth of the bytes that the dedup behind it moves, so
    partitions joined by those bytes would hold twenty times as much in the sort. Their number follows the count
    of rows instead (read from the footers of the files) and is not coalesced. Keys are unique: no partition is hot."""
    return table.repartition(parts(table.count(), table.sparkSession.sparkContext.defaultParallelism), key)


def raw_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benign flow union injected scenarios, in RAW_FIX_SCHEMA."""
    events, orders = (spread(t, k) for t, k in zip(read_tables(spark, sf_dir, "events", "orders"), ("event_id", "o_orderkey")))
    sc = scenario_events(scenario_params(orders), dims.templates(spark))
    return benign_events(events).unionByName(sc)


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    (orders,) = read_tables(spark, sf_dir, "orders")
    return scenario_labels(scenario_params(orders), dims.label_templates(spark))


assert [f.name for f in RAW_FIX_SCHEMA.fields] == [n for n, _ in RAW_FIX_FIELDS]
