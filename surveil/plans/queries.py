"""Query registry: name -> (spark, sf_dir) -> DataFrame, plus the matching oracle SQL.

Every query reads the driver tables (through the feed adapter) in full; none caps,
samples or subsets its input.  Column names are aliased identically on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveil.operators import bronze as B
from surveil.operators import detectors as D
from surveil.operators import govern as GV
from surveil.operators import labels as LB
from surveil.operators import links as L
from surveil.operators import silver as S
from surveil.plans import medallion as M
from surveil.plans import oracle as O
from surveil.schemas import DETECTORS
from surveil.session import stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


_RAW = ", ".join(O.RAW_COLS)
_BASE = O.base()


def _sql(select: str) -> str:
    return O.with_ctes(_BASE, select)


# ---------------------------------------------------------------------------
# Bronze / DQ
# ---------------------------------------------------------------------------

@query("bronze_clean", _sql(f"SELECT {_RAW}, _ingest_ts, _source FROM bronze"))
def bronze_clean(spark, sf):
    return M.bronze(spark, sf)


@query("bronze_quarantine", _sql(
    f"SELECT {_RAW}, _ingest_ts, _source, array_to_string(list_filter(["
    + ", ".join(f"CASE WHEN {c} IS NULL THEN '{c}' END" for c in O.REQUIRED)
    + "], lambda x: x IS NOT NULL), ',') AS dq_missing FROM tagged WHERE NOT _ok"))
def bronze_quarantine(spark, sf):
    q = B.bronze_quarantine(M.raw(spark, sf))
    return q.withColumn("dq_missing", F.array_join("_dq_missing", ",")).drop("_dq_missing")


def _dq_sql() -> str:
    ok = "_ok"
    parts = [("rows_total", "count(*)"), ("rows_clean", f"sum(CASE WHEN {ok} THEN 1 ELSE 0 END)"),
             ("rows_quarantined", f"sum(CASE WHEN {ok} THEN 0 ELSE 1 END)")]
    parts += [(f"null_{c}", f"sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)") for c in O.REQUIRED]
    strings = ["msg_type", "cl_ord_id", "trader_id", "account", "symbol", "side", "ord_type", "exchange_id"]
    parts += [(f"empty_{c}", f"sum(CASE WHEN {c} = '' THEN 1 ELSE 0 END)") for c in strings]
    parts += [("bad_side", "sum(CASE WHEN NOT (side IN ('1', '2')) THEN 1 ELSE 0 END)"),
              ("bad_msg_type", "sum(CASE WHEN NOT (msg_type IN ('D', '8', 'F', 'G')) THEN 1 ELSE 0 END)"),
              ("nonpositive_qty", "sum(CASE WHEN order_qty <= 0 THEN 1 ELSE 0 END)")]
    wide = ", ".join(f"CAST(coalesce({e}, 0) AS BIGINT) AS {n}" for n, e in parts)
    unpiv = " UNION ALL ".join(f"SELECT '{n}' AS metric, {n} AS value FROM w" for n, _ in parts)
    return O.with_ctes(_BASE + [f"w AS (SELECT {wide} FROM tagged)"], unpiv)


@query("dq_metrics", _dq_sql())
def dq_metrics(spark, sf):
    return B.dq_metrics(M.raw(spark, sf))


# ---------------------------------------------------------------------------
# Silver
# ---------------------------------------------------------------------------

@query("silver_events", _sql(f"SELECT {_RAW}, _ingest_ts, _source, event_kind, asset_class, desk, is_buy, notional "
                             "FROM silver"))
def silver_events(spark, sf):
    return M.silver(spark, sf)


@query("dup_audit", _sql("SELECT cl_ord_id, msg_type, transact_time, exec_id, count(*) AS n_copies FROM bronze "
                         "GROUP BY cl_ord_id, msg_type, transact_time, exec_id HAVING count(*) > 1"))
def dup_audit(spark, sf):
    return S.dup_audit(M.bronze(spark, sf))


# ---------------------------------------------------------------------------
# Gold
# ---------------------------------------------------------------------------

@query("gold_features", _sql(f"SELECT {O.GOLD_COLS} FROM gold"))
def gold_features(spark, sf):
    return M.gold(spark, sf, 60_000)


SUBTICK = 0.00001


@query("gold_subtick", O.with_ctes(
    O.feed_ctes() + O.medallion_ctes() + [f"tiny AS (SELECT * REPLACE (price * {O.d(SUBTICK)} AS price, last_px * {O.d(SUBTICK)} "
                                          "AS last_px) FROM silver)", O.gold_cte("gold_t", 86_400_000, "tiny")],
    f"SELECT {O.GOLD_COLS} FROM gold_t"))
def gold_subtick(spark, sf):
    """Daily features over prices far below a cent: nothing is rounded away."""
    from surveil.operators import gold as G
    s = M.silver(spark, sf, G.INPUT_COLUMNS)
    return M.gold_of(s.withColumns({c: F.col(c) * F.lit(SUBTICK) for c in ("price", "last_px")}), M.DAILY_MS)


@query("gold_daily", _sql(f"SELECT {O.GOLD_COLS} FROM gold_d"))
def gold_daily(spark, sf):
    return M.gold(spark, sf, M.DAILY_MS)


def _states_sql() -> str:
    sums = ["sum(CASE WHEN event_kind = 'NEW' THEN 1 ELSE 0 END) AS BIGINT) AS n_orders",
            "sum(CASE WHEN event_kind = 'CANCEL' THEN 1 ELSE 0 END) AS BIGINT) AS n_cancels",
            "sum(CASE WHEN event_kind = 'EXEC' THEN 1 ELSE 0 END) AS BIGINT) AS n_execs",
            "sum(CASE WHEN event_kind = 'NEW' AND is_buy THEN order_qty ELSE 0 END) AS BIGINT) AS buy_qty",
            "sum(CASE WHEN event_kind = 'NEW' AND NOT is_buy THEN order_qty ELSE 0 END) AS BIGINT) AS sell_qty"]
    start = f"CAST(transact_time - {O.pmod('transact_time', 3_600_000)} AS BIGINT)"
    return _sql(f"SELECT trader_id, symbol, {start} AS window_start, desk, asset_class, price, "
                + ", ".join(f"CAST({s}" for s in sums) + ", min(transact_time) AS first_time, max(transact_time) AS last_time "
                "FROM silver GROUP BY ALL")


@query("gold_states_hourly", _states_sql())
def gold_states_hourly(spark, sf):
    """Minute states in two deliveries (by a hash of the order id), merged to hours."""
    from surveil.operators import gold as G
    from surveil.operators import gold_states as GS
    silver, half = M.stored_silver(spark, sf, G.INPUT_COLUMNS), F.pmod(F.xxhash64("cl_ord_id"), F.lit(2))
    parts = [GS.to_states(silver.filter(half == i), constant=S.UNMAPPED) for i in (0, 1)]
    return GS.merge(stored(parts[0].union(parts[1]), "states"), 3_600_000, constant=S.UNMAPPED).select(
        *GS.STATE_KEYS, "n_orders", "n_cancels", "n_execs", "buy_qty", "sell_qty", "first_time", "last_time")


@query("gold_daily_from_states", _sql(f"SELECT {O.GOLD_COLS} FROM gold_d"))
def gold_daily_from_states(spark, sf):
    """Daily gold from stored minute states alone."""
    from surveil.operators import gold as G
    from surveil.operators import gold_states as GS
    states = GS.to_states(M.silver(spark, sf, G.INPUT_COLUMNS), constant=S.UNMAPPED)
    return GS.to_gold(stored(states, "states"), M.DAILY_MS, constant=S.UNMAPPED)


# ---------------------------------------------------------------------------
# Detectors and alerts
# ---------------------------------------------------------------------------

_DET_KEYS = {"SPOOFING": "det_spoofing", "WASH_TRADE": "det_wash_trade", "FRONT_RUNNING": "det_front_running",
             "MOMENTUM_IGNITION": "det_momentum", "MARKING_THE_CLOSE": "det_marking_close"}


def _det_query(det: str):
    def fn(spark, sf):
        return M.alerts_report(M.alerts(spark, sf, 60_000, [det]))
    fn.__name__ = _DET_KEYS[det]
    return fn


for _det, _key in _DET_KEYS.items():
    query(_key, _sql(f"SELECT {O.ALERT_REPORT} FROM alerts WHERE detector = '{_det}'"))(_det_query(_det))


@query("alerts_all", _sql(f"SELECT {O.ALERT_REPORT} FROM alerts"))
def alerts_all(spark, sf):
    return M.alerts_report(M.alerts(spark, sf))


_CHURN = ("CASE WHEN n_orders < 2 OR n_execs > n_cancels THEN 0D "
          "ELSE least(1D, 0.4D + 0.6D * least(order_to_trade_ratio / 6D, 1D)) END")
_CHURN_SQL = (f"CASE WHEN n_orders < 2 OR n_execs > n_cancels THEN {O.d(0)} ELSE least({O.d(1)}, {O.d(0.4)} + {O.d(0.6)} * "
              f"least(order_to_trade_ratio / {O.d(6)}, {O.d(1)})) END")


@query("alerts_sql_rule", O.with_ctes(O.feed_ctes() + O.medallion_ctes() + O.alert_ctes(
    "gold_d", "alerts_r", rules={"ORDER_CHURN": (_CHURN_SQL, 0.7, ["UMIR_2.2"])}), f"SELECT {O.ALERT_REPORT} FROM alerts_r"))
def alerts_sql_rule(spark, sf):
    """Daily alerts of the five detectors and of a rule that exists as SQL text only."""
    from surveil.operators import rules as RU
    churn = RU.define(spark, "ORDER_CHURN", ["n_orders", "n_execs", "n_cancels", "order_to_trade_ratio"], _CHURN, 0.7, ("UMIR_2.2",))
    return M.alerts_report(M.alerts(spark, sf, M.DAILY_MS, [*DETECTORS, churn]))


@query("alerts_daily", _sql(f"SELECT {O.ALERT_REPORT} FROM alerts_d"))
def alerts_daily(spark, sf):
    return M.alerts_report(M.alerts(spark, sf, M.DAILY_MS))


@query("alert_ids", _sql("SELECT detector, trader_id, instrument, window_start, window_end, alert_id FROM alerts"))
def alert_ids(spark, sf):
    return M.alerts(spark, sf).select("detector", "trader_id", "instrument", "window_start", "window_end", "alert_id")


@query("canonical_body", _sql("SELECT alert_id, lower(hex(encode(_body))) AS body_hex FROM alerts"))
def canonical_body(spark, sf):
    a = M.alerts(spark, sf)
    return a.select("alert_id", F.lower(F.hex(F.encode(D.alert_body(a), "UTF-8"))).alias("body_hex"))


@query("alert_digest", _sql("SELECT alert_id, detector, sha256(_body) AS audit_hash, "
                            "(window_start // 60000) % 5 <> 0 AS verified FROM alerts"))
def alert_digest(spark, sf):
    """Stored digests checked against a recomputation, after every fifth window's alerts were altered."""
    a = M.alerts(spark, sf)
    altered = F.floor(F.col("window_start") / 60_000) % 5 == 0
    a = a.withColumn("severity", F.when(altered, F.col("severity") + 1).otherwise(F.col("severity")))
    return a.select("alert_id", "detector", "audit_hash",
                    (F.sha2(D.alert_body(a), 256) == F.col("audit_hash")).alias("verified"))


#: multiples of 2**-9, of 5e-9 and of 1/7: ninth-decimal ties, decimal near-ties and plain values, both signs
@query("canonical_floats", "WITH k AS (SELECT o_orderkey, CAST(o_orderkey % 4096 AS DOUBLE) / CAST(512 AS DOUBLE) AS tie, "
       "CAST(2 * (o_orderkey % 100000) + 1 AS DOUBLE) * CAST(0.000000005 AS DOUBLE) AS near, "
       "-(CAST(o_orderkey AS DOUBLE) / CAST(7 AS DOUBLE)) AS plain FROM orders) "
       f"SELECT o_orderkey, {O.f8('tie')} AS tie, {O.f8('near')} AS near, {O.f8('plain')} AS plain, "
       f"CASE WHEN o_orderkey % 2 = 0 THEN '-0.00000000' ELSE {O.f8('-near')} END AS negative FROM k")
def canonical_floats(spark, sf):
    """The audit grammar's float rendering over values derived from the order keys."""
    from surveil.functions.grammar import fixed8
    k = F.col("o_orderkey").cast("double")
    tie, near, plain = F.pmod(k, F.lit(4096.0)) / 512.0, (2 * F.pmod(k, F.lit(100000.0)) + 1) * 0.000000005, -(k / 7.0)
    return spark.read.parquet(f"{sf}/orders.parquet").select(
        "o_orderkey", fixed8(tie).alias("tie"), fixed8(near).alias("near"), fixed8(plain).alias("plain"),
        fixed8(F.when(F.pmod(k, F.lit(2.0)) == 0, F.lit(-0.0)).otherwise(-near)).alias("negative"))


@query("severity_hist", _sql("SELECT detector, severity, count(*) AS n_alerts, min(rule_score) AS min_score, "
                             "max(rule_score) AS max_score FROM alerts GROUP BY detector, severity"))
def severity_hist(spark, sf):
    return (M.alerts(spark, sf).groupBy("detector", "severity")
            .agg(F.count(F.lit(1)).alias("n_alerts"), F.min("rule_score").alias("min_score"),
                 F.max("rule_score").alias("max_score")))


# ---------------------------------------------------------------------------
# Sources / serialisation
# ---------------------------------------------------------------------------

def _json_sql() -> str:
    kv = []
    for n in O.RAW_COLS:
        kv.append(f"CASE WHEN {n} IS NOT NULL THEN '\"{n}\":' || CAST(to_json({n}) AS VARCHAR) END")
    return _sql("SELECT cl_ord_id, msg_type, transact_time, '{' || concat_ws(',', " + ", ".join(kv)
                + ") || '}' AS event_json FROM feed")


@query("event_json", _json_sql())
def event_json(spark, sf):
    from surveil.sources import raw as R
    return R.to_event_json(M.raw(spark, sf))


# Seven faults, by the event time modulo this; the other events stay as they are.
FAULT_EVERY = 13


def _faulty(spark, sf):
    """The feed as JSON texts, some of them damaged."""
    from surveil.sources import raw as R
    j, fault = F.col("event_json"), F.pmod(F.col("transact_time"), F.lit(FAULT_EVERY))
    text = (F.when(fault == 0, F.substring_index(j, ",", 3))
            .when(fault == 1, F.concat(F.lit("["), j, F.lit("]")))
            .when(fault == 2, F.regexp_replace(j, r"^\{", '{"venue_note":"late",'))
            .when(fault == 3, F.regexp_replace(j, r'"order_qty":(\d+)', '"order_qty":"$1"'))
            .when(fault == 4, F.regexp_replace(j, '"price":', '"price":"n/a","px_old":'))
            .when(fault == 5, F.regexp_replace(j, '"symbol":"', '"symbol":7,"was":"'))
            .when(fault == 6, F.regexp_replace(j, r'"order_qty":(\d+)', '"order_qty":$1.5')).otherwise(j))
    return stored(R.to_event_json(M.raw(spark, sf)).select(text.alias("value")), "texts")


def _faulty_ctes() -> list[str]:
    kv = ", ".join(f"CASE WHEN {n} IS NOT NULL THEN '\"{n}\":' || CAST(to_json({n}) AS VARCHAR) END" for n in O.RAW_COLS)
    fault = O.pmod("transact_time", FAULT_EVERY)
    qty = "'\"order_qty\":(\\d+)'"
    numbers = {"order_qty": "('UBIGINT', 'BIGINT', 'NULL')", "transact_time": "('UBIGINT', 'BIGINT', 'NULL')",
               "last_qty": "('UBIGINT', 'BIGINT', 'NULL')", "price": "('UBIGINT', 'BIGINT', 'DOUBLE', 'NULL')",
               "last_px": "('UBIGINT', 'BIGINT', 'DOUBLE', 'NULL')"}
    fits = {c: f"json_type(value, '$.{c}') IN {numbers.get(c, chr(40) + chr(39) + 'VARCHAR' + chr(39) + ', ' + chr(39) + 'NULL' + chr(39) + chr(41))}"
            for c in O.RAW_COLS}
    clash = ", ".join(f"CASE WHEN NOT ({f}) THEN 'type:{c}' END" for c, f in fits.items())
    known = "[" + ", ".join(f"'{c}'" for c in O.RAW_COLS) + "]"
    # a number in a text field is read as its digits, any other clash as NULL
    read = {c: f"json_extract_string(value, '$.{c}') IS NULL" + (f" OR NOT ({fits[c]})" if c in numbers else "") for c in O.REQUIRED}
    missing = ", ".join(f"CASE WHEN {r} THEN 'missing:{c}' END" for c, r in read.items())
    return [
        f"js AS (SELECT transact_time, {fault} AS fault, '{{' || concat_ws(',', {kv}) || '}}' AS j FROM feed)",
        f"""texts AS MATERIALIZED (SELECT CASE fault WHEN 0 THEN array_to_string(string_split(j, ',')[1:3], ',') WHEN 1 THEN '[' || j || ']'
  WHEN 2 THEN '{{"venue_note":"late",' || substr(j, 2) WHEN 3 THEN regexp_replace(j, {qty}, '"order_qty":"\\1"')
  WHEN 4 THEN replace(j, '"price":', '"price":"n/a","px_old":') WHEN 5 THEN replace(j, '"symbol":"', '"symbol":7,"was":"')
  WHEN 6 THEN regexp_replace(j, {qty}, '"order_qty":\\1.5') ELSE j END AS value FROM js)""",
        f"""judged AS MATERIALIZED (SELECT value, CASE WHEN NOT json_valid(value) THEN ['unparseable']
  WHEN json_type(value) <> 'OBJECT' THEN ['not_object'] ELSE list_filter(list_concat(list_concat([{clash}],
    list_transform(list_sort(list_filter(json_keys(value), lambda k: NOT list_contains({known}, k))), lambda k: 'unknown:' || k)),
    [{missing}]), lambda r: r IS NOT NULL) END AS reasons FROM texts)"""]


@query("ingest_quarantine", O.with_ctes(O.feed_ctes() + _faulty_ctes(),
       "SELECT value AS event_text, array_to_string(reasons, ',') AS reasons FROM judged WHERE len(reasons) > 0"))
def ingest_quarantine(spark, sf):
    """Events that could not be read as they stand, with their text and all reasons."""
    from surveil.operators import ingest as I
    q = I.quarantined(I.parse(_faulty(spark, sf)), allow_unknown=False)
    return q.select(F.col(I.RAW_TEXT).alias("event_text"), F.array_join(I.REASONS, ",").alias("reasons"))


@query("ingest_reasons", O.with_ctes(O.feed_ctes() + _faulty_ctes(),
       "SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM judged) GROUP BY reason"))
def ingest_reasons(spark, sf):
    from surveil.operators import ingest as I
    return I.reason_counts(I.parse(_faulty(spark, sf)))


# ---------------------------------------------------------------------------
# Links
# ---------------------------------------------------------------------------

_LINK_CTES = [
    "lc AS MATERIALIZED (SELECT cl_ord_id, orig_cl_ord_id, trader_id, symbol, transact_time AS cancel_time, order_qty, "
    "cancel_reason FROM silver WHERE event_kind = 'CANCEL')",
    "lo AS MATERIALIZED (SELECT cl_ord_id AS orig_cl_ord_id, trader_id AS o_trader_id, symbol AS o_symbol, "
    "transact_time AS order_time, order_qty AS o_order_qty, price AS o_price, side AS o_side "
    "FROM silver WHERE event_kind = 'NEW')",
]


@query("cancel_link", O.with_ctes(_BASE + _LINK_CTES,
       "SELECT lc.cl_ord_id, lc.orig_cl_ord_id, trader_id, symbol, order_time, cancel_time, "
       "cancel_time - order_time AS cancel_latency_ms, o_order_qty, o_price, o_side, "
       "(trader_id = o_trader_id AND symbol = o_symbol) AS same_owner FROM lc JOIN lo USING (orig_cl_ord_id)"))
def cancel_link(spark, sf):
    return L.cancel_link(M.stored_silver(spark, sf))


@query("orphan_cancels", O.with_ctes(_BASE + _LINK_CTES,
       "SELECT orig_cl_ord_id, cl_ord_id, trader_id, symbol, cancel_time, order_qty, cancel_reason FROM lc "
       "WHERE NOT EXISTS (SELECT 1 FROM lo WHERE lo.orig_cl_ord_id = lc.orig_cl_ord_id)"))
def orphan_cancels(spark, sf):
    return L.orphan_cancels(M.stored_silver(spark, sf))


@query("order_exec_join", O.with_ctes(_BASE + [
    "on_ AS MATERIALIZED (SELECT cl_ord_id, trader_id, symbol, side, transact_time, order_qty, price FROM silver WHERE event_kind = 'NEW')",
    "xs AS MATERIALIZED (SELECT cl_ord_id, transact_time, exec_id, last_qty, last_px FROM silver WHERE event_kind = 'EXEC')"],
    "SELECT * FROM (SELECT o.cl_ord_id, o.trader_id, o.symbol, o.side, o.transact_time AS order_time, x.transact_time AS exec_time, "
    "x.exec_id, x.transact_time - o.transact_time AS fill_latency_ms, o.order_qty, o.price, x.last_qty, x.last_px "
    "FROM on_ o JOIN xs x ON o.cl_ord_id = x.cl_ord_id) WHERE fill_latency_ms BETWEEN 0 AND 60000"))
def order_exec_join(spark, sf):
    return L.order_exec_join(M.stored_silver(spark, sf), 60_000)


@query("uncancelled_orders", O.with_ctes(_BASE + [
    "un AS MATERIALIZED (SELECT cl_ord_id, trader_id, symbol, side, transact_time, order_qty, price, scenario_type FROM silver WHERE event_kind = 'NEW')",
    "uc AS MATERIALIZED (SELECT DISTINCT orig_cl_ord_id FROM silver WHERE event_kind = 'CANCEL' AND orig_cl_ord_id IS NOT NULL)"],
       "SELECT un.* FROM un ANTI JOIN uc ON uc.orig_cl_ord_id = un.cl_ord_id"))
def uncancelled_orders(spark, sf):
    return L.uncancelled_orders(M.stored_silver(spark, sf)).select(
        "cl_ord_id", "trader_id", "symbol", "side", "transact_time", "order_qty", "price", "scenario_type")


@query("alert_events", _sql(
    "SELECT a.alert_id, a.detector, a.trader_id, a.instrument, a.window_start, s.cl_ord_id, s.msg_type, "
    "s.transact_time, s.exec_id FROM alerts a JOIN silver s ON a.trader_id = s.trader_id AND a.instrument = s.symbol "
    f"AND a.window_start = s.transact_time - {O.pmod('s.transact_time', 60_000)}"))
def alert_events(spark, sf):
    from surveil.operators import gold as G
    s = M.stored_silver(spark, sf, G.INPUT_COLUMNS)
    return L.alert_events(M.alerts_of(s), s).drop("window_end")


@query("alert_events_daily", _sql(
    "SELECT a.alert_id, a.detector, a.trader_id, a.instrument, a.window_start, s.cl_ord_id, s.msg_type, "
    "s.transact_time, s.exec_id FROM alerts_d a JOIN silver s ON a.trader_id = s.trader_id AND a.instrument = s.symbol "
    f"AND a.window_start = s.transact_time - {O.pmod('s.transact_time', 86_400_000)}"))
def alert_events_daily(spark, sf):
    from surveil.operators import gold as G
    s = M.stored_silver(spark, sf, G.INPUT_COLUMNS)
    return L.alert_events(M.alerts_of(s, M.DAILY_MS), s).drop("window_end")


@query("qty_by_instrument", _sql(
    "SELECT symbol AS instrument, CAST(sum(order_qty) AS BIGINT) AS qty, count(*) AS n_orders FROM silver "
    "WHERE event_kind = 'NEW' GROUP BY symbol"))
def qty_by_instrument(spark, sf):
    """Simple keyed sum (partial aggregation before the shuffle)."""
    return (M.silver(spark, sf).filter(F.col("event_kind") == "NEW").groupBy(F.col("symbol").alias("instrument"))
            .agg(F.sum("order_qty").alias("qty"), F.count(F.lit(1)).alias("n_orders")))


# ---------------------------------------------------------------------------
# Scenarios and labels
# ---------------------------------------------------------------------------

@query("label_integrity", _sql(
    "SELECT scenario_id, abuse_type, count(*) AS n_ids, count(_hit) AS n_found, count(*) = count(_hit) AS ok "
    "FROM (SELECT scenario_id, abuse_type, unnest(list_distinct(CASE WHEN ends_with(scenario_id, '7') "
    "THEN list_append(injected_event_ids, scenario_id || '-none') ELSE injected_event_ids END)) AS cl_ord_id FROM labels) i "
    "LEFT JOIN (SELECT DISTINCT scenario_id, cl_ord_id, 1 AS _hit FROM feed WHERE scenario_id IS NOT NULL) e "
    "USING (scenario_id, cl_ord_id) GROUP BY scenario_id, abuse_type"))
def label_integrity(spark, sf):
    from surveil.sources import feed
    lab = feed.labels(spark, sf)
    missing = F.concat("injected_event_ids", F.array(F.concat("scenario_id", F.lit("-none"))))
    lab = lab.withColumn("injected_event_ids", F.when(F.col("scenario_id").endswith("7"), missing).otherwise(F.col("injected_event_ids")))
    return L.label_integrity(lab, M.raw(spark, sf))


def _lw_cte(w: int) -> str:
    ws, we = f"window_start - {O.pmod('window_start', w)}", f"window_end - {O.pmod('window_end', w)}"
    return (f"lw AS (SELECT DISTINCT trader_id, symbol, abuse_type, window_start FROM ("
            f"SELECT trader_id, instrument AS symbol, abuse_type, unnest(generate_series({ws}, {we}, {w})) "
            f"AS window_start FROM labels))")


@query("labelled_windows", O.with_ctes(_BASE + [_lw_cte(60_000)],
       "SELECT g.*, CAST(CASE WHEN h._hit IS NOT NULL THEN 1 ELSE 0 END AS INTEGER) AS label FROM gold g "
       "LEFT JOIN (SELECT DISTINCT trader_id, symbol, window_start, 1 AS _hit FROM lw) h "
       "USING (trader_id, symbol, window_start)"))
def labelled_windows(spark, sf):
    from surveil.sources import feed
    return LB.labelled_windows(M.gold(spark, sf), feed.labels(spark, sf))


@query("detection_matrix", O.with_ctes(_BASE + [_lw_cte(60_000)],
       "SELECT abuse_type, " + ", ".join(f"count(*) FILTER (WHERE detector = '{d}') AS {d}" for d in DETECTORS)
       + " FROM (SELECT a.detector, coalesce(l.abuse_type, 'BENIGN') AS abuse_type FROM alerts a LEFT JOIN lw l "
       "ON a.trader_id = l.trader_id AND a.instrument = l.symbol AND a.window_start = l.window_start) "
       "GROUP BY abuse_type"))
def detection_matrix(spark, sf):
    from surveil.sources import feed
    return LB.detection_matrix(M.alerts(spark, sf), feed.labels(spark, sf))


def _conformance_sql() -> str:
    ab = "NOT ends_with(trader_id, '-client')"
    new, fill, can = "msg_type = 'D'", "(msg_type = '8' AND exec_type = '2')", "msg_type = 'F'"
    buy, sell = "side = '1'", "side = '2'"

    def cnt(c):
        return f"CAST(sum(CASE WHEN {c} THEN 1 ELSE 0 END) AS BIGINT)"

    def mn(c, v):
        return f"min(CASE WHEN {c} THEN {v} END)"

    def mx(c, v):
        return f"max(CASE WHEN {c} THEN {v} END)"

    sc = ("sc AS (SELECT *, CASE WHEN lag(msg_type = 'D') OVER w THEN lag(price) OVER w END AS _prev_px "
          "FROM feed WHERE scenario_id IS NOT NULL "
          "WINDOW w AS (PARTITION BY scenario_id ORDER BY msg_type = 'D', transact_time, cl_ord_id))")
    agg = f"""ag AS (SELECT scenario_id, scenario_type AS abuse_type, count(*) AS n_events,
  {cnt(f'{new} AND {buy} AND {ab}')} AS n_abuser_buys, {cnt(f'{new} AND {sell} AND {ab}')} AS n_abuser_sells,
  {cnt(can)} AS n_cancels, {cnt(fill)} AS n_fills,
  {mn(f'{new} AND {buy} AND {ab}', 'order_qty')} AS min_buy_qty,
  {mn(f'{fill} AND {sell} AND {ab}', 'transact_time')} AS t_sell_fill,
  {mn(f'{fill} AND {buy} AND {ab}', 'transact_time')} AS t_abuser_buy_fill,
  {mn(f'{new} AND {buy} AND {ab}', 'transact_time')} AS t_abuser_buy,
  {mn(f'{fill} AND NOT {ab}', 'transact_time')} AS t_client_fill,
  {mx(f'{fill} AND {buy}', 'transact_time')} AS t_last_buy_fill,
  {mn(can, 'transact_time')} AS t_first_cancel, {mx(new, 'transact_time')} AS t_last_new,
  {mx(f'{fill} AND {buy} AND {ab}', 'last_px')} AS px_abuser_buy,
  {mx(f'{fill} AND {sell} AND {ab}', 'last_px')} AS px_abuser_sell,
  {mx(f'{new} AND {buy}', 'price')} AS px_peak_buy, {mx(new, 'price')} AS px_max_new, {mx(fill, 'last_px')} AS px_fill,
  count(DISTINCT CASE WHEN {new} THEN price END) AS n_new_prices,
  count(DISTINCT CASE WHEN {new} THEN order_qty END) AS n_new_qtys,
  count(DISTINCT CASE WHEN {fill} THEN transact_time END) AS n_fill_times,
  count(DISTINCT trader_id) AS n_traders,
  {cnt(f'{new} AND _prev_px IS NOT NULL AND price <= _prev_px AND {buy}')} AS n_non_escalating,
  {cnt(f'{new} AND NOT ({buy})')} AS n_new_sells, {cnt(f"{new} AND ord_type <> '2'")} AS n_new_non_limit
  FROM sc GROUP BY scenario_id, scenario_type)"""
    ok = """coalesce(CASE abuse_type
  WHEN 'SPOOFING' THEN n_abuser_buys >= 4 AND min_buy_qty >= 5000 AND n_fills = 1 AND t_sell_fill < t_first_cancel
  WHEN 'WASH_TRADE' THEN n_traders = 1 AND n_abuser_buys >= 1 AND n_abuser_sells >= 1 AND n_new_prices = 1
       AND n_new_qtys = 1 AND n_fills = 2 AND n_fill_times = 1
  WHEN 'FRONT_RUNNING' THEN t_abuser_buy < t_client_fill AND t_abuser_buy_fill < t_client_fill
       AND px_abuser_sell > px_abuser_buy
  WHEN 'MOMENTUM_IGNITION' THEN n_non_escalating = 0 AND t_sell_fill > t_last_buy_fill AND px_abuser_sell = px_peak_buy
  WHEN 'MARKING_THE_CLOSE' THEN n_new_sells = 0 AND n_new_non_limit = 0 AND n_non_escalating = 0 AND n_fills = 1
       AND px_fill >= px_max_new AND t_last_buy_fill > t_last_new
  ELSE false END, false)"""
    return O.with_ctes(_BASE + [sc, agg],
                       "SELECT scenario_id, abuse_type, n_events, n_abuser_buys, n_abuser_sells, n_cancels, n_fills, "
                       f"n_non_escalating, {ok} AS conformant FROM ag")


@query("scenario_conformance", _conformance_sql())
def scenario_conformance(spark, sf):
    return LB.scenario_conformance(M.raw(spark, sf))


# ---------------------------------------------------------------------------
# Governance
# ---------------------------------------------------------------------------

MASK_KEY = "a key for the registered queries"      # production keys are secret and passed in


def _masked(col: str, prefix: str) -> str:
    return (f"'{prefix}' || sha256(sha256('{MASK_KEY}|outer') || sha256(sha256('{MASK_KEY}|inner') || {col}))")


@query("masked_alerts", _sql(
    f"SELECT {_masked('alert_id', 'ALT-')} AS alert_id, detector, {_masked('trader_id', 'TRD-')} AS trader_id, instrument, "
    "window_start, window_end, severity, rule_score, desk FROM alerts"))
def masked_alerts(spark, sf):
    return GV.masked_alerts(M.alerts(spark, sf), MASK_KEY).select(
        "alert_id", "detector", "trader_id", "instrument", "window_start", "window_end", "severity", "rule_score", "desk")


@query("masked_events", _sql(
    f"SELECT cl_ord_id, msg_type, transact_time, {_masked('trader_id', 'TRD-')} AS trader_id, "
    f"{_masked('account', 'ACC-')} AS account, symbol, side, order_qty, price FROM silver"))
def masked_events(spark, sf):
    """Governed view of silver: trader and account pseudonymised with a key."""
    return GV.masked_events(M.silver(spark, sf), MASK_KEY).select(
        "cl_ord_id", "msg_type", "transact_time", "trader_id", "account", "symbol", "side", "order_qty", "price")


def _every(n: int) -> str:
    return f"((window_start // 60000) % {n} = 0)"


def _violations_sql() -> str:
    dets = ", ".join(f"'{d}'" for d in DETECTORS)
    checks = [
        ("detector_enum", f"NOT (detector IN ({dets}))"), ("desk_enum", _every(3)),
        ("severity_range", _every(5)),
        ("rule_score_range", "rule_score < 0.0 OR rule_score > 1.0"),
        ("ml_score_range", _every(7)),
        ("shap_rank", _every(11)), ("shap_direction", _every(13)),
        ("audit_hash_format", _every(4)),
        ("alert_id_format", "NOT regexp_full_match(alert_id, "
                            "'[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}')"),
        ("window_order", "window_end <= window_start"),
    ]
    arr = "list_filter([" + ", ".join(f"CASE WHEN coalesce({c}, true) THEN '{n}' END" for n, c in checks)         + "], lambda x: x IS NOT NULL)"
    return _sql(f"SELECT alert_id, detector, CAST(len(v) AS INTEGER) AS n_violations, array_to_string(v, ',') "
                f"AS violations FROM (SELECT *, {arr} AS v FROM alerts)")


@query("alert_violations", _violations_sql())
def alert_violations(spark, sf):
    """Contract checks over alerts, some of which were broken in each way by their window."""
    def every(n):
        return F.floor(F.col("window_start") / 60_000) % n == 0

    def broken(n, bad, good):
        return F.when(every(n), bad).otherwise(F.col(good))
    shap = F.array(F.struct(F.lit("n_orders").alias("feature_name"), F.lit(1.0).alias("feature_value"), F.lit(1.0).alias("shap_value"),
                            F.when(every(11), 0).otherwise(1).alias("rank"),
                            F.when(every(13), "sideways").otherwise("increases").alias("direction")))
    a = M.alerts(spark, sf).withColumns({
        "desk": broken(3, F.lit("fx"), "desk"), "severity": broken(5, F.lit(6), "severity"),
        "ml_score": F.when(every(7), F.lit(1.5)).otherwise(F.lit(0.5)), "shap_top_features": shap,
        "audit_hash": broken(4, F.upper(F.concat("audit_hash", F.lit("x"))), "audit_hash")})
    v = GV.alert_violations(a)
    return v.select("alert_id", "detector", F.size("violations").alias("n_violations"),
                    F.array_join("violations", ",").alias("violations"))


# ---------------------------------------------------------------------------
# Audit chain
# ---------------------------------------------------------------------------

def _sequenced(spark, sf):
    """Audit entries with their chains. Every plan reads them once, so they are not stored in between."""
    from surveil.operators import audit as AU
    return AU.assign_chains(AU.entries_from_alerts(M.alerts(spark, sf)), O.N_CHAINS)


def _chain(spark, sf):
    from surveil.operators import audit as AU
    return AU.append(_sequenced(spark, sf))


_CHAIN = _BASE + O.chain_ctes()


@query("chain_body", O.with_ctes(_CHAIN, "SELECT chain_id, seq, ref_id, lower(hex(encode(body))) AS body_hex "
                                         "FROM seqd", recursive=True))
def chain_body(spark, sf):
    from surveil.operators import audit as AU
    return _sequenced(spark, sf).select("chain_id", "seq", "ref_id",
                                        F.lower(F.hex(F.encode(AU.entry_body(), "UTF-8"))).alias("body_hex"))


@query("chain_body_nulls", _sql(
    f"SELECT alert_id AS ref_id, lower(hex(encode('detector' || {O.US} || 'NOTE' || {O.US} || alert_id || {O.US} || "
    f"CAST(window_start AS VARCHAR) || {O.US} || detector || {O.US} || {O.NUL} || {O.US} || trader_id))) AS body_hex FROM alerts"))
def chain_body_nulls(spark, sf):
    """Bodies of entries with a null payload element: it is rendered, not dropped."""
    from surveil.operators import audit as AU
    a = M.alerts(spark, sf)
    body = AU.entry_body(F.lit("detector"), F.lit("NOTE"), F.col("alert_id"), F.col("window_start"),
                         F.array("detector", F.lit(None).cast("string"), "trader_id"))
    return a.select(F.col("alert_id").alias("ref_id"), F.lower(F.hex(F.encode(body, "UTF-8"))).alias("body_hex"))


@query("chain_append", O.with_ctes(_CHAIN, "SELECT chain_id, seq, ref_id, prev_hash, entry_hash FROM chain",
                                   recursive=True))
def chain_append(spark, sf):
    return _chain(spark, sf).select("chain_id", "seq", "ref_id", "prev_hash", "entry_hash")


@query("chain_verify", O.with_ctes(_CHAIN + [
    "vchk AS (SELECT c.chain_id, c.seq, c.entry_hash, (c.entry_hash = sha256(coalesce(lag(c.entry_hash) OVER w, "
    "repeat('0', 64)) || '|' || s.body)) AND (c.prev_hash = coalesce(lag(c.entry_hash) OVER w, repeat('0', 64))) "
    "AND (c.seq = row_number() OVER w) AS good FROM chain c JOIN seqd s USING (chain_id, seq) "
    "WINDOW w AS (PARTITION BY c.chain_id ORDER BY c.seq))"],
    "SELECT chain_id, count(*) AS n_entries, CAST(sum(CASE WHEN good THEN 0 ELSE 1 END) AS BIGINT) AS n_bad, "
    "min(CASE WHEN NOT good THEN seq END) AS first_bad_seq, arg_max(entry_hash, seq) AS head_hash, "
    "sum(CASE WHEN good THEN 0 ELSE 1 END) = 0 AS verified FROM vchk GROUP BY chain_id", recursive=True))
def chain_verify(spark, sf):
    from surveil.operators import audit as AU
    return AU.verify(_chain(spark, sf))


@query("chain_verify_tampered", O.with_ctes(_CHAIN,
    "SELECT chain_id, count(*) AS n_entries, CAST(sum(CASE WHEN t THEN 1 ELSE 0 END) AS BIGINT) AS n_bad, "
    "min(CASE WHEN t THEN seq END) AS first_bad_seq, arg_max(entry_hash, seq) AS head_hash, "
    "sum(CASE WHEN t THEN 1 ELSE 0 END) = 0 AS verified "
    "FROM (SELECT *, seq % 5 = 0 AND chain_id % 3 = 0 AS t FROM chain) GROUP BY chain_id", recursive=True))
def chain_verify_tampered(spark, sf):
    """Verification of chains in which some entries' action was edited after linking."""
    from surveil.operators import audit as AU
    c = _chain(spark, sf)
    hit = (F.col("seq") % 5 == 0) & (F.col("chain_id") % 3 == 0)
    return AU.verify(c.withColumn("action", F.when(hit, F.lit("EDITED")).otherwise(F.col("action"))))


@query("merkle_roots", O.with_ctes(_CHAIN + O.merkle_ctes(), "SELECT * FROM merkle", recursive=True))
def merkle_roots(spark, sf):
    from surveil.operators import audit as AU
    return AU.merkle_roots(_chain(spark, sf), O.MERKLE_BLOCK).withColumn("n_leaves", F.col("n_leaves").cast("long"))


@query("merkle_inclusion", O.with_ctes(_CHAIN + O.merkle_ctes() + O.inclusion_ctes(), "SELECT * FROM proofs", recursive=True))
def merkle_inclusion(spark, sf):
    """The sibling path of every audit entry up to its block's root."""
    from surveil.operators import merkle as MK
    p = MK.inclusion_proofs(_chain(spark, sf), O.MERKLE_BLOCK)
    side = lambda x: F.concat(F.when(x["left"], F.lit("L")).otherwise(F.lit("R")), x["hash"])
    return p.select("chain_id", "seq", "block", "merkle_root", F.array_join(F.transform("path", side), ",").alias("path"))


@query("merkle_inclusion_check", O.with_ctes(_CHAIN + O.merkle_ctes() + O.inclusion_ctes(),
       "SELECT chain_id, seq, (path = '' OR seq % 5 > 1) AND seq % 5 <> 2 AS ok FROM proofs", recursive=True))
def merkle_inclusion_check(spark, sf):
    """Paths checked against the stored roots after every fifth was given a foreign hash, turned around, or moved to another entry."""
    from surveil.operators import audit as AU
    from surveil.operators import merkle as MK
    chain = stored(_chain(spark, sf).select("chain_id", "seq", "entry_hash"), "chain")
    p = MK.inclusion_proofs(chain, O.MERKLE_BLOCK)
    kind = F.col("seq") % 5
    foreign = F.transform("path", lambda x, i: F.struct(x["left"].alias("left"), F.when(i == 0, F.sha2(x["hash"], 256)).otherwise(x["hash"]).alias("hash")))
    turned = F.transform("path", lambda x: F.struct((~x["left"]).alias("left"), x["hash"].alias("hash")))
    p = p.withColumns({"path": F.when(kind == 0, foreign).when(kind == 1, turned).otherwise(F.col("path")),
                       "entry_hash": F.when(kind == 2, F.sha2("entry_hash", 256)).otherwise(F.col("entry_hash"))})
    return MK.check_inclusion(p, AU.merkle_roots(chain, O.MERKLE_BLOCK))


def _heads(chain):
    """Anchors at two thirds of each chain, and the sizes of both trees."""
    anchors = chain.groupBy("chain_id").agg((F.floor(F.max("seq") * 2 / 3) + 1).cast("long").alias("n_entries"))
    return anchors, anchors.select("chain_id", F.col("n_entries").alias("n")), chain.groupBy("chain_id").agg(F.max("seq").alias("n"))


@query("merkle_consistency", O.with_ctes(_CHAIN + O.consistency_ctes(), "SELECT * FROM consistency", recursive=True))
def merkle_consistency(spark, sf):
    """Proofs that each chain's tree begins with the tree anchored at two thirds of it, with both heads."""
    from surveil.operators import merkle as MK
    chain = stored(_chain(spark, sf).select("chain_id", "seq", "entry_hash"), "chain")
    anchors, old, new = _heads(chain)
    p = MK.consistency_proofs(chain, anchors)
    return (p.join(MK.tree_heads(chain, old).toDF("chain_id", "m", "old_root"), ["chain_id", "m"])
            .join(MK.tree_heads(chain, new).toDF("chain_id", "n", "new_root"), ["chain_id", "n"])
            .select("chain_id", "m", "n", "old_root", "new_root", F.array_join("proof", ",").alias("proof")))


@query("merkle_consistency_check", O.with_ctes(_CHAIN + O.consistency_ctes(),
       "SELECT chain_id, m, n, chain_id % 4 = 3 AS ok FROM consistency", recursive=True))
def merkle_consistency_check(spark, sf):
    """Consistency checked after some chains had an early entry rewritten and rechained, a proof hash forged, or one dropped."""
    from surveil.operators import merkle as MK
    chain = stored(_chain(spark, sf).select("chain_id", "seq", "entry_hash"), "chain")
    anchors, old, new = _heads(chain)
    kind = F.col("chain_id") % 4
    rewritten = chain.withColumn("entry_hash", F.when((kind == 0) & (F.col("seq") == 1), F.sha2("entry_hash", 256)).otherwise(F.col("entry_hash")))
    p = MK.consistency_proofs(rewritten, anchors)
    forged = F.transform("proof", lambda h, i: F.when(i == F.size("proof") - 1, F.sha2(h, 256)).otherwise(h))
    p = p.withColumn("proof", F.when(kind == 1, forged).when(kind == 2, F.slice("proof", F.lit(1), F.size("proof") - 1)).otherwise(F.col("proof")))
    return MK.check_consistency(p, MK.tree_heads(chain, old), MK.tree_heads(rewritten, new))


# ---------------------------------------------------------------------------
# Streaming spike, batch equivalent: per-instrument running quantity by day
# ---------------------------------------------------------------------------

@query("running_qty", _sql(
    "SELECT instrument, batch_day, qty, CAST(sum(qty) OVER (PARTITION BY instrument ORDER BY batch_day "
    "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS running FROM ("
    f"SELECT symbol AS instrument, transact_time - {O.pmod('transact_time', 86_400_000)} AS batch_day, "
    "CAST(sum(order_qty) AS BIGINT) AS qty FROM silver WHERE event_kind = 'NEW' GROUP BY 1, 2)"))
def running_qty(spark, sf):
    from surveil.streaming import running
    return running.running_qty_batch(M.silver(spark, sf))


# ---------------------------------------------------------------------------
# ML operators on a deterministic stand-in probability (max rule score)
# ---------------------------------------------------------------------------

ALPHA = 0.1


def _scored(spark, sf):
    """Labelled windows with the stand-in probability, split. The windows are stored in the columns that any plan
    reads: the split (sizes and cuts of the classes) and the plans behind it read them several times."""
    from surveil.operators import ml as ML
    from surveil.sources import feed
    g = D.score_all(LB.labelled_windows(M.gold(spark, sf), feed.labels(spark, sf)))
    p1 = F.greatest(*[F.col(f"score_{d.lower()}") for d in DETECTORS])
    g = stored(g.select("trader_id", "symbol", "window_start", "label", p1.alias("p1")), "windows")
    return ML.split(g, ["trader_id", "symbol", "window_start"], 0.7, 0)


def _scored_sql() -> list[str]:
    h = ("CAST('0x' || substr(sha256(trader_id || '|' || symbol || '|' || CAST(window_start AS VARCHAR) || '|0'), "
         "1, 8) AS BIGINT)")
    return _BASE + [_lw_cte(60_000),
                    "lab AS (SELECT g.*, CAST(CASE WHEN h._hit IS NOT NULL THEN 1 ELSE 0 END AS INTEGER) AS label "
                    "FROM gold g LEFT JOIN (SELECT DISTINCT trader_id, symbol, window_start, 1 AS _hit FROM lw) h "
                    "USING (trader_id, symbol, window_start))",
                    "sc AS (SELECT *, greatest(" + ", ".join(f"({O.SCORES[d]})" for d in DETECTORS) + ") AS p1, "
                    f"CASE WHEN rank() OVER (PARTITION BY label ORDER BY {h}) <= round_even(0.7 * count(*) OVER "
                    "(PARTITION BY label), 0) THEN 'train' ELSE 'cal' END AS split FROM lab)",
                    "cal AS (SELECT CAST(1.0 AS DOUBLE) - CASE WHEN label = 1 THEN p1 ELSE CAST(1.0 AS DOUBLE) - p1 END "
                    "AS nc FROM sc WHERE split = 'cal')",
                    "calr AS (SELECT n, CAST(least(n - 1, ceil(least(1.0, ceil((n + 1) * (CAST(1.0 AS DOUBLE) - "
                    f"CAST({ALPHA} AS DOUBLE))) / n) * (n - 1))) AS BIGINT) AS k0 FROM (SELECT count(*) AS n FROM cal))",
                    "qh AS (SELECT (SELECT n FROM calr) AS n_cal, (SELECT k0 FROM calr) AS k0, nc AS qhat FROM "
                    "(SELECT nc, row_number() OVER (ORDER BY nc) - 1 AS r FROM cal) WHERE r = (SELECT k0 FROM calr))"]


@query("train_cal_split", O.with_ctes(_scored_sql(), "SELECT trader_id, symbol, window_start, label, split FROM sc"))
def train_cal_split(spark, sf):
    return _scored(spark, sf).select("trader_id", "symbol", "window_start", "label", "split")


@query("class_weights", O.with_ctes(_scored_sql(),
       "SELECT label, count(*) AS n, CASE WHEN label = 1 THEN CAST(greatest((SELECT count(*) FROM sc WHERE "
       "split = 'train' AND label = 0), 1) AS DOUBLE) / greatest((SELECT count(*) FROM sc WHERE split = 'train' "
       "AND label = 1), 1) ELSE CAST(1.0 AS DOUBLE) END AS weight FROM sc WHERE split = 'train' GROUP BY label"))
def class_weights(spark, sf):
    from surveil.operators import ml as ML
    return ML.class_weights(_scored(spark, sf).filter(F.col("split") == "train"))


def _qhat(scored):
    from surveil.operators import ml as ML
    return ML.qhat(scored.filter(F.col("split") == "cal"), "p1", "label", ALPHA)


@query("conformal_qhat", O.with_ctes(_scored_sql(), f"SELECT n_cal, k0, CAST({ALPHA} AS DOUBLE) AS alpha, qhat FROM qh"))
def conformal_qhat(spark, sf):
    from surveil.operators import ml as ML
    cal = _scored(spark, sf).filter(F.col("split") == "cal")
    nc = stored(cal.select(ML.nonconformity(F.col("p1"), F.col("label")).alias("nc")), "nonconformity")
    n = nc.count()
    k0 = ML.qhat_rank(n, ALPHA)
    return ML.kth_smallest(nc, "nc", k0).select(
        F.lit(n).cast("long").alias("n_cal"), F.lit(k0).cast("long").alias("k0"),
        F.lit(ALPHA).alias("alpha"), F.col("nc").alias("qhat"))


@query("conformal_set", O.with_ctes(_scored_sql(),
       "SELECT trader_id, symbol, window_start, label, p1, array_to_string(cs, ',') AS conformal_set, "
       "len(cs) <> 1 AS needs_human FROM (SELECT *, list_filter([CASE WHEN CAST(1.0 AS DOUBLE) - p1 >= "
       "CAST(1.0 AS DOUBLE) - (SELECT qhat FROM qh) THEN 0 END, CASE WHEN p1 >= CAST(1.0 AS DOUBLE) - "
       "(SELECT qhat FROM qh) THEN 1 END], lambda x: x IS NOT NULL) AS cs FROM sc)"))
def conformal_set(spark, sf):
    from surveil.operators import ml as ML
    scored = _scored(spark, sf)
    q, _, _ = _qhat(scored)
    out = ML.conformal_set(scored, q, "p1")
    return out.select("trader_id", "symbol", "window_start", "label", "p1",
                      F.array_join(F.col("conformal_set").cast("array<string>"), ",").alias("conformal_set"),
                      "needs_human")


def _topk_sql(k: int = 5) -> str:
    from surveil.schemas import FEATURES
    un = " UNION ALL ".join(f"SELECT trader_id, symbol, window_start, {i} AS i, '{n}' AS feature_name, "
                            f"CAST({n} AS DOUBLE) AS v FROM gold" for i, n in enumerate(FEATURES))
    return _sql("SELECT trader_id, symbol, window_start, rank, feature_name, v AS feature_value, v AS shap_value, "
                "CASE WHEN v >= 0 THEN 'increases' ELSE 'decreases' END AS direction FROM ("
                "SELECT *, CAST(row_number() OVER (PARTITION BY trader_id, symbol, window_start "
                f"ORDER BY abs(v) DESC, i) AS INTEGER) AS rank FROM ({un})) WHERE rank <= {k}")


@query("topk_contrib", _topk_sql())
def topk_contrib(spark, sf):
    """Top-5 |attribution| with rank and direction; stand-in attributions = feature values."""
    from surveil.operators import ml as ML
    from surveil.schemas import FEATURES
    g = M.gold(spark, sf)
    t = g.select("trader_id", "symbol", "window_start",
                 F.explode(ML.top_k(ML.feature_vector(FEATURES), FEATURES, 5)).alias("c"))
    return t.select("trader_id", "symbol", "window_start", "c.rank", "c.feature_name", "c.feature_value",
                    "c.shap_value", "c.direction")


# ---------------------------------------------------------------------------
# Scoring, explanation and calibration with a fixed small model (checked against SQL)
# ---------------------------------------------------------------------------

#: (treeID, id, prediction, cover, left, right, feature, threshold); feature indexes TREE_FEATURES, -1 = leaf.
#: Values and cover ratios are dyadic, so sums are exact in any order.
TREE_FEATURES = ["n_orders", "cancel_ratio", "distinct_prices"]
TREE_NODES = [
    (0, 0, 0.0, 128.0, 1, 2, 0, 3.5), (0, 1, -0.5, 64.0, -1, -1, -1, 0.0), (0, 2, 0.0, 64.0, 3, 4, 1, 0.5),
    (0, 3, 0.25, 16.0, -1, -1, -1, 0.0), (0, 4, 0.75, 48.0, -1, -1, -1, 0.0),
    (1, 0, 0.0, 128.0, 1, 2, 2, 2.5), (1, 1, -0.25, 64.0, -1, -1, -1, 0.0), (1, 2, 0.5, 64.0, -1, -1, -1, 0.0),
]


def _fixed_scores(gold):
    """gold + shap_values, base value and margin (base + attributions) of the fixed trees."""
    import pandas as pd
    from surveil.operators import scorer as SC
    nodes = pd.DataFrame(TREE_NODES, columns=["treeID", "id", "prediction", "cover", "left", "right", "feature", "threshold"])
    leaves = SC.leaves_from_nodes(nodes, [1.0, 1.0])
    base = 2.0 * leaves.base
    df = gold.withColumn("shap_values", SC.shap_values(leaves, TREE_FEATURES)).withColumn("base_value", F.lit(base))
    return df.withColumn("margin", F.lit(base) + F.aggregate("shap_values", F.lit(0.0), lambda a, x: a + x))


_TREE_CTES = [
    "tx AS (SELECT *, n_orders > 3.5 AS o1, cancel_ratio > CAST(0.5 AS DOUBLE) AS o2, distinct_prices > 2.5 AS o3 FROM gold)",
    # conditional expectations of tree 0 given feature sets: none, {1}, {2}, {1, 2}; right leaf holds 3/4 of its node
    "tv AS (SELECT *, CAST(0.0625 AS DOUBLE) AS v0, CAST(CASE WHEN o1 THEN 0.625 ELSE -0.5 END AS DOUBLE) AS v1, "
    "CAST(CASE WHEN o2 THEN 0.125 ELSE -0.125 END AS DOUBLE) AS v2, "
    "CAST(CASE WHEN NOT o1 THEN -0.5 WHEN o2 THEN 0.75 ELSE 0.25 END AS DOUBLE) AS v12, "
    "CAST(CASE WHEN o3 THEN 0.5 ELSE -0.25 END AS DOUBLE) AS v3 FROM tx)",
    "tp AS (SELECT *, (v1 - v0) + (v12 - v2) AS p1, (v2 - v0) + (v12 - v1) AS p2, 2 * (v3 - CAST(0.125 AS DOUBLE)) AS p3, "
    "CAST(0.375 AS DOUBLE) AS base_value FROM tv)",
]


@query("tree_shap", O.with_ctes(_BASE + _TREE_CTES,
       "SELECT trader_id, symbol, window_start, base_value, base_value + p1 + p2 + p3 AS margin, "
       "p1 AS shap_n_orders, p2 AS shap_cancel_ratio, p3 AS shap_distinct_prices FROM tp"))
def tree_shap(spark, sf):
    """Margin, base value and attributions of a fixed two-tree model for every window."""
    return _fixed_scores(M.gold(spark, sf)).select(
        "trader_id", "symbol", "window_start", "base_value", "margin",
        *[F.element_at("shap_values", i + 1).alias(f"shap_{n}") for i, n in enumerate(TREE_FEATURES)])


@query("alerts_enriched_fixed", O.with_ctes(_BASE + _TREE_CTES + [
    "tt AS (SELECT trader_id, symbol, window_start, base_value + p1 + p2 + p3 AS margin, unnest([0, 1, 2]) AS i, "
    "unnest(['n_orders', 'cancel_ratio', 'distinct_prices']) AS f, unnest([p1, p2, p3]) AS p FROM tp)",
    "tk AS (SELECT *, row_number() OVER (PARTITION BY trader_id, symbol, window_start ORDER BY abs(p) DESC, i) AS r FROM tt)"],
    f"SELECT a.alert_id, a.detector, a.severity, sha256(a._body) AS audit_hash, greatest({O.d(0)}, least({O.d(1)}, k.margin)) AS ml_score, "
    "k.f AS top_feature, k.p AS top_shap FROM alerts a JOIN tk k ON a.trader_id = k.trader_id AND a.instrument = k.symbol "
    "AND a.window_start = k.window_start WHERE k.r = 1"))
def alerts_enriched_fixed(spark, sf):
    """Alerts enriched with score and top attribution of the fixed model; digest and severity stay."""
    from surveil.functions.grammar import clip01
    from surveil.operators import ml as ML
    from surveil.operators import scorer as SC
    gold = stored(M.gold(spark, sf), "gold")           # read for the alerts, twice, and for the scores
    alerts = D.detect(gold, None, M.CREATED_AT)
    scored = _fixed_scores(SC.alerted_windows(gold, alerts)).withColumn("ml_score", clip01(F.col("margin")))
    scored = scored.withColumn("shap_top_features", ML.top_k(F.col("shap_values"), TREE_FEATURES, 2))
    top = F.element_at("shap_top_features", 1)
    return SC.enrich_alerts(alerts, scored).select("alert_id", "detector", "severity", "audit_hash", "ml_score",
                                                   top["feature_name"].alias("top_feature"), top["shap_value"].alias("top_shap"))


@query("calibration_fixed", O.with_ctes(_scored_sql() + [
    "pt AS MATERIALIZED (SELECT round(p1, 2) AS raw_score, CAST(sum(label) AS DOUBLE) AS s, CAST(count(*) AS DOUBLE) AS n FROM sc GROUP BY 1)",
    "cum AS MATERIALIZED (SELECT raw_score, s, n, sum(s) OVER w AS cs, sum(n) OVER w AS cn FROM pt WINDOW w AS (ORDER BY raw_score))",
    # isotonic fit: max over starts a <= x of the min over ends b >= x of the mean label of [a, b]
    "mm AS (SELECT x.raw_score, a.raw_score AS lo, min((b.cs - a.cs + a.s) / (b.cn - a.cn + a.n)) AS m FROM cum x "
    "JOIN cum a ON a.raw_score <= x.raw_score JOIN cum b ON b.raw_score >= x.raw_score GROUP BY 1, 2)"],
    "SELECT raw_score, max(m) AS calibrated FROM mm GROUP BY raw_score"))
def calibration_fixed(spark, sf):
    """Isotonic calibration of (rule score to two places, label) pairs, by distinct score."""
    from surveil.operators import scorer as SC
    pairs = _scored(spark, sf).select(F.round("p1", 2).alias("raw_score"), "label")
    return SC.calibrator(pairs).transform(pairs.select("raw_score").distinct()).select("raw_score", F.col("_cal").alias("calibrated"))


# ---------------------------------------------------------------------------
# Model scoring (rows-only: boosted trees are not SQL-expressible)
# ---------------------------------------------------------------------------

def _fitted(spark, sf):
    from surveil.operators import scorer as SC
    from surveil.sources import feed
    lw = stored(LB.labelled_windows(M.gold(spark, sf), feed.labels(spark, sf)), "windows")   # fit, then scored
    return SC.fit(lw, seed=0, alpha=ALPHA), lw


@query("ml_scores")
def ml_scores(spark, sf):
    """Every gold window scored: calibrated ml_score, conformal set, top-5 SHAP features."""
    from surveil.operators import scorer as SC
    model, lw = _fitted(spark, sf)
    s = SC.score(model, lw)
    return s.select("trader_id", "symbol", "window_start", "label", "raw_score", "ml_score",
                    F.array_join(F.col("conformal_set").cast("array<string>"), ",").alias("conformal_set"),
                    "needs_human", F.lit(model.shap_base_value).alias("shap_base_value"),
                    F.array_join(F.transform("shap_top_features", lambda x: x["feature_name"]), ",")
                    .alias("top_features"))


@query("ml_alerts")
def ml_alerts(spark, sf):
    """Alerts enriched with the model score and explanation (severity and digest unchanged)."""
    from surveil.operators import scorer as SC
    model, lw = _fitted(spark, sf)
    gold = lw.drop("label")
    alerts = D.detect(gold, None, M.CREATED_AT)        # from the stored windows: the medallion runs once
    a = SC.enrich_alerts(alerts, SC.score(model, SC.alerted_windows(gold, alerts)))
    return a.select("alert_id", "detector", "trader_id", "instrument", "window_start", "severity", "rule_score",
                    "ml_score", F.element_at("shap_top_features", 1)["feature_name"].alias("top_feature"),
                    F.size("shap_top_features").alias("n_features"), "audit_hash")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
