"""DuckDB oracle SQL for the query registry.

Independent re-statements of each Spark query in plain SQL over the pre-registered
driver views.  A shared CTE prefix restates the feed adapter and the medallion; the
fixed template tables are rendered from the same literals the Spark side broadcasts.
"""

from __future__ import annotations

from surveil.schemas import CLOSE_MS_OF_DAY, DAY_MS
from surveil.sources import dims, feed

W60 = 60_000
W1D = 86_400_000


def pmod(a: str, n: int | str) -> str:
    return f"(((({a}) % ({n})) + ({n})) % ({n}))"


def _lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    if isinstance(v, list):
        return "[" + ", ".join(_lit(x) for x in v) + "]"
    return str(v)


def _values(rows, cols, types) -> str:
    body = ",\n    ".join("(" + ", ".join(f"CAST({_lit(v)} AS {t})" for v, t in zip(r, types)) + ")" for r in rows)
    return f"SELECT * FROM (VALUES\n    {body}) AS t({', '.join(cols)})"


_SYMS = "[" + ", ".join(f"'{s}'" for s, _, _, _ in dims.INSTRUMENTS) + "]"
_MIDS = "[" + ", ".join(str(m) for _, _, m, _ in dims.INSTRUMENTS) + "]"
_ARCH = "[" + ", ".join(f"'{a}'" for a in dims.ARCHETYPES) + "]"
_N = len(dims.INSTRUMENTS)

RAW_COLS = ["msg_type", "cl_ord_id", "trader_id", "account", "symbol", "side", "order_qty", "ord_type",
            "transact_time", "exchange_id", "price", "exec_type", "order_id", "exec_id", "last_qty", "last_px",
            "orig_cl_ord_id", "cancel_reason", "scenario_id", "scenario_type"]
REQUIRED = ["msg_type", "cl_ord_id", "trader_id", "account", "symbol", "side", "order_qty", "ord_type",
            "transact_time", "exchange_id"]


def _ms(ts: str) -> str:
    us = f"epoch_us({ts})"
    return f"(({us} - {pmod(us, 1000)}) // 1000)"


def feed_ctes() -> list[str]:
    tpl_types = ["VARCHAR", "INTEGER", "VARCHAR", "VARCHAR", "VARCHAR", "BIGINT", "VARCHAR", "INTEGER",
                 "BIGINT", "VARCHAR", "VARCHAR", "VARCHAR", "VARCHAR", "VARCHAR"]
    tpl = _values(dims.TEMPLATES, dims.TEMPLATE_COLUMNS, tpl_types)
    ltpl = _values(dims.LABEL_TEMPLATES, ["archetype", "end_dt", "id_sfx"], ["VARCHAR", "BIGINT", "VARCHAR[]"])
    msg = "CASE event_type " + " ".join(f"WHEN '{e}' THEN '{m}'" for e, m in feed.BENIGN_MSG) + " END"
    k = "TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)"
    benign_src = f"""benign_src AS (
  SELECT event_id, ts, user_id, {msg} AS msg,
         {k} AS k,
         'T-' || lpad(CAST({pmod('user_id', dims.N_BENIGN_TRADERS)} AS VARCHAR), 3, '0') AS trader,
         ({pmod('event_id', 20)} + 1) * 100 AS qty
  FROM events CROSS JOIN (VALUES (0), (1)) AS cp(copy_no)
  WHERE copy_no = 0 OR {pmod('event_id', feed.REDELIVER_EVERY)} = 0)"""
    price = f"CAST({_MIDS}[{pmod('k', _N)} + 1] + {pmod('k', 11)} - 5 AS DOUBLE) / CAST(100.0 AS DOUBLE)"
    benign = f"""benign AS (
  SELECT msg AS msg_type, 'n-' || CAST(event_id AS VARCHAR) AS cl_ord_id, trader AS trader_id,
         'ACC-' || trader AS account,
         CASE WHEN {pmod('k', feed.NULL_SYMBOL_EVERY)} <> 0 THEN {_SYMS}[{pmod('k', _N)} + 1] END AS symbol,
         CASE WHEN {pmod('event_id', 2)} = 0 THEN '1' ELSE '2' END AS side,
         CAST(qty AS BIGINT) AS order_qty, '2' AS ord_type, CAST({_ms('ts')} AS BIGINT) AS transact_time,
         'TSX' AS exchange_id,
         CASE WHEN msg <> 'F' THEN {price} END AS price,
         CASE WHEN msg = '8' THEN '2' END AS exec_type,
         CAST(NULL AS VARCHAR) AS order_id,
         CASE WHEN msg = '8' THEN 'e-' || CAST(event_id AS VARCHAR) END AS exec_id,
         CASE WHEN msg = '8' THEN CAST(qty AS BIGINT) END AS last_qty,
         CASE WHEN msg = '8' THEN {price} END AS last_px,
         CASE WHEN msg = 'F' THEN 'n-' || CAST(event_id - 1 AS VARCHAR) END AS orig_cl_ord_id,
         CAST(NULL AS VARCHAR) AS cancel_reason, CAST(NULL AS VARCHAR) AS scenario_id,
         CAST(NULL AS VARCHAR) AS scenario_type
  FROM benign_src)"""
    params = f"""params0 AS (
  SELECT 'sc-' || CAST(o_orderkey AS VARCHAR) AS scenario_id,
         {_ARCH}[{pmod('o_orderkey', len(dims.ARCHETYPES))} + 1] AS archetype,
         'A-' || lpad(CAST({pmod('o_custkey', dims.N_ABUSIVE_TRADERS)} AS VARCHAR), 3, '0') AS abuser_id,
         {_SYMS}[{pmod('o_custkey', _N)} + 1] AS symbol,
         {_MIDS}[{pmod('o_custkey', _N)} + 1] AS mid_cents,
         {_ms('o_orderdate')} AS day_ms, o_orderkey
  FROM orders),
params AS (
  SELECT scenario_id, archetype, abuser_id, 'ACC-' || abuser_id AS abuser_account, symbol, mid_cents,
         CAST(CASE WHEN archetype = 'MARKING_THE_CLOSE' THEN day_ms + {CLOSE_MS_OF_DAY - feed.MTC_LEAD_MS}
              ELSE day_ms + {pmod('o_orderkey * 7', feed.SCENARIO_MINUTES)} * 60000 END AS BIGINT) AS t0
  FROM params0)"""
    sx = lambda c: f"CASE WHEN {c} IS NOT NULL THEN p.scenario_id || '-' || {c} END"
    sprice = "CASE WHEN ticks IS NOT NULL THEN CAST(mid_cents + ticks AS DOUBLE) / CAST(100.0 AS DOUBLE) END"
    scen = f"""scen AS (
  SELECT t_msg AS msg_type, {sx('sfx')} AS cl_ord_id,
         CASE WHEN who = 'C' THEN p.scenario_id || '-client' ELSE abuser_id END AS trader_id,
         CASE WHEN who = 'C' THEN p.scenario_id || '-client-acc' ELSE abuser_account END AS account,
         symbol, t_side AS side, t_qty AS order_qty, t_ord_type AS ord_type,
         CAST(t0 + dt AS BIGINT) AS transact_time, 'TSX' AS exchange_id,
         {sprice} AS price,
         CASE WHEN t_msg = '8' THEN '2' END AS exec_type,
         {sx('oid_sfx')} AS order_id, {sx('eid_sfx')} AS exec_id,
         CASE WHEN t_msg = '8' THEN t_qty END AS last_qty,
         CASE WHEN t_msg = '8' THEN {sprice} END AS last_px,
         {sx('orig_sfx')} AS orig_cl_ord_id, reason AS cancel_reason,
         p.scenario_id AS scenario_id, archetype AS scenario_type
  FROM params p JOIN tpl USING (archetype))"""
    labels = """labels AS (
  SELECT p.scenario_id, archetype AS abuse_type, abuser_id AS trader_id, symbol AS instrument,
         t0 AS window_start, t0 + end_dt AS window_end,
         list_transform(id_sfx, lambda s: p.scenario_id || '-' || s) AS injected_event_ids
  FROM params p JOIN ltpl USING (archetype))"""
    cols = ", ".join(RAW_COLS)
    feed_cte = f"feed AS (SELECT {cols} FROM benign UNION ALL SELECT {cols} FROM scen)"
    return [f"tpl AS ({tpl})", f"ltpl AS ({ltpl})", benign_src, benign, params, scen, labels, feed_cte]


def medallion_ctes() -> list[str]:
    req = " AND ".join(f"{c} IS NOT NULL" for c in REQUIRED)
    kind = "CASE msg_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in
                                        [("D", "NEW"), ("8", "EXEC"), ("F", "CANCEL"), ("G", "REPLACE")]) \
        + " ELSE 'OTHER' END"
    return [
        f"tagged AS (SELECT *, CAST(0 AS BIGINT) AS _ingest_ts, 'fix.local' AS _source, ({req}) AS _ok FROM feed)",
        f"bronze AS (SELECT {', '.join(RAW_COLS)}, _ingest_ts, _source FROM tagged WHERE _ok)",
        f"""silver AS MATERIALIZED (
  SELECT *, {kind} AS event_kind, 'equity' AS asset_class, 'equity' AS desk, side = '1' AS is_buy,
         coalesce(order_qty * price, CAST(0.0 AS DOUBLE)) AS notional
  FROM (SELECT DISTINCT ON (cl_ord_id, msg_type, transact_time, exec_id) * FROM bronze))""",
        gold_cte("gold", W60),
        gold_cte("gold_d", W1D),
    ]


def gold_cte(name: str, w: int, src: str = "silver") -> str:
    t = "transact_time"
    fill = "event_kind = 'EXEC' AND last_px IS NOT NULL AND last_qty IS NOT NULL"
    # the price as written (shortest decimal), times the quantity: no rounding, no float sums
    paid = "CAST(CAST(last_px AS VARCHAR) AS DECIMAL(27, 18)) * CAST(last_qty AS DECIMAL(10, 0))"
    ordk = "(transact_time, price)"
    return f"""{name}_g AS (
  SELECT trader_id, symbol, desk, asset_class, CAST({t} - {pmod(t, w)} AS BIGINT) AS window_start,
         CAST({CLOSE_MS_OF_DAY} - {pmod(t, DAY_MS)} AS DOUBLE) / CAST(1000.0 AS DOUBLE) AS _stc,
         event_kind, is_buy, order_qty, price, last_qty, last_px, transact_time, cl_ord_id, msg_type, exec_id
  FROM {src}),
{name}_a AS (
  SELECT trader_id, symbol, window_start, desk, asset_class,
    CAST(sum(CASE WHEN event_kind = 'NEW' THEN 1 ELSE 0 END) AS BIGINT) AS n_orders,
    CAST(sum(CASE WHEN event_kind = 'CANCEL' THEN 1 ELSE 0 END) AS BIGINT) AS n_cancels,
    CAST(sum(CASE WHEN event_kind = 'EXEC' THEN 1 ELSE 0 END) AS BIGINT) AS n_execs,
    CAST(sum(CASE WHEN event_kind = 'NEW' AND is_buy THEN order_qty ELSE 0 END) AS BIGINT) AS buy_qty,
    CAST(sum(CASE WHEN event_kind = 'NEW' AND NOT is_buy THEN order_qty ELSE 0 END) AS BIGINT) AS sell_qty,
    count(DISTINCT price) AS distinct_prices,
    min(_stc) AS secs_to_close,
    arg_min(price, {ordk}) FILTER (WHERE price IS NOT NULL) AS _first_px,
    arg_max(price, {ordk}) FILTER (WHERE price IS NOT NULL) AS _last_px,
    min(price) AS _min_px, max(price) AS _max_px,
    CAST(sum(CASE WHEN {fill} AND is_buy THEN last_qty END) AS BIGINT) AS _bq,
    sum(CASE WHEN {fill} AND is_buy THEN {paid} END) AS _bpaid,
    CAST(sum(CASE WHEN {fill} AND NOT is_buy THEN last_qty END) AS BIGINT) AS _sq,
    sum(CASE WHEN {fill} AND NOT is_buy THEN {paid} END) AS _spaid
  FROM {name}_g GROUP BY trader_id, symbol, window_start, desk, asset_class),
{name}_b AS (
  SELECT *, window_start + {w} AS window_end,
    coalesce(_first_px, CAST(0.0 AS DOUBLE)) AS first_px, coalesce(_last_px, CAST(0.0 AS DOUBLE)) AS last_px,
    coalesce(_min_px, CAST(0.0 AS DOUBLE)) AS min_px, coalesce(_max_px, CAST(0.0 AS DOUBLE)) AS max_px,
    coalesce(CASE WHEN _bq <> 0 THEN CAST(CAST(_bpaid AS VARCHAR) AS DOUBLE) / CAST(_bq AS DOUBLE) END,
             CAST(0.0 AS DOUBLE)) AS buy_vwap,
    coalesce(CASE WHEN _sq <> 0 THEN CAST(CAST(_spaid AS VARCHAR) AS DOUBLE) / CAST(_sq AS DOUBLE) END,
             CAST(0.0 AS DOUBLE)) AS sell_vwap,
    CAST(n_cancels AS DOUBLE) / CAST(greatest(n_orders, 1) AS DOUBLE) AS cancel_ratio,
    CAST(n_orders AS DOUBLE) / CAST(greatest(n_execs, 1) AS DOUBLE) AS order_to_trade_ratio,
    CAST(buy_qty - sell_qty AS DOUBLE) / CAST(greatest(buy_qty + sell_qty, 1) AS DOUBLE) AS qty_imbalance
  FROM {name}_a),
{name} AS (
  SELECT trader_id, symbol, window_start, desk, asset_class, n_orders, n_cancels, n_execs, buy_qty, sell_qty,
    distinct_prices, secs_to_close, first_px, last_px, min_px, max_px, buy_vwap, sell_vwap, window_end,
    cancel_ratio, order_to_trade_ratio, qty_imbalance,
    CASE WHEN first_px > 0 THEN (last_px - first_px) / first_px * CAST(10000.0 AS DOUBLE)
         ELSE CAST(0.0 AS DOUBLE) END AS price_move_bps,
    CASE WHEN buy_vwap > 0 AND sell_vwap > 0 THEN (sell_vwap - buy_vwap) / buy_vwap * CAST(10000.0 AS DOUBLE)
         ELSE CAST(0.0 AS DOUBLE) END AS round_trip_gain_bps
  FROM {name}_b)"""


def d(x: float) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"


# Detector scores restated in SQL (same operation order as the Column builders).
SCORES = {
    "SPOOFING": (f"CASE WHEN n_orders < 4 THEN {d(0)} ELSE greatest({d(0)}, least({d(1)}, "
                 f"{d(0.7)} * cancel_ratio + {d(0.3)} * least(order_to_trade_ratio / {d(10)}, {d(1)}))) END"),
    "WASH_TRADE": (f"CASE WHEN buy_qty <= 0 OR sell_qty <= 0 OR n_execs < 2 OR abs(qty_imbalance) > {d(0.1)} "
                   f"OR abs(round_trip_gain_bps) > {d(1)} THEN {d(0)} ELSE greatest({d(0)}, least({d(1)}, "
                   f"{d(0.6)} * ({d(1)} - least(abs(qty_imbalance), {d(1)})) + {d(0.4)} * "
                   f"(CASE WHEN distinct_prices <= 2 THEN {d(1)} ELSE {d(0.5)} END))) END"),
    "FRONT_RUNNING": (f"CASE WHEN n_execs < 2 OR abs(qty_imbalance) > {d(0.1)} OR round_trip_gain_bps <= {d(1)} "
                      f"OR buy_qty <= 0 OR sell_qty <= 0 THEN {d(0)} ELSE least({d(1)}, {d(0.6)} + {d(0.4)} * "
                      f"least(round_trip_gain_bps / {d(10)}, {d(1)})) END"),
    "MOMENTUM_IGNITION": (f"CASE WHEN n_execs < 4 OR price_move_bps <= {d(0)} OR cancel_ratio > {d(0.2)} "
                          f"OR sell_qty <= 0 THEN {d(0)} ELSE least({d(1)}, {d(0.4)} * least(n_execs / {d(6)}, {d(1)}) "
                          f"+ {d(0.3)} + {d(0.1)} * least(price_move_bps / {d(5)}, {d(1)})) END"),
    "MARKING_THE_CLOSE": (f"CASE WHEN secs_to_close < {d(0)} OR secs_to_close > {d(120)} OR price_move_bps <= {d(0)} "
                          f"OR n_execs < 1 OR buy_qty <= 0 THEN {d(0)} ELSE least({d(1)}, {d(0.3)} + {d(0.3)} * "
                          f"({d(1)} - least(secs_to_close / {d(120)}, {d(1)})) + {d(0.2)} * "
                          f"least(price_move_bps / {d(5)}, {d(1)}) + {d(0.2)} * (CASE WHEN last_px >= max_px - "
                          f"{d(1e-9)} AND max_px > 0 THEN {d(1)} ELSE {d(0.5)} END)) END"),
}
THRESHOLDS = {"SPOOFING": 0.5, "WASH_TRADE": 0.6, "FRONT_RUNNING": 0.5, "MOMENTUM_IGNITION": 0.5,
              "MARKING_THE_CLOSE": 0.5}
REFS = {"SPOOFING": ["UMIR_2.2", "MIFID_II_ART12"], "WASH_TRADE": ["UMIR_2.2", "MIFID_II_ART12"],
        "FRONT_RUNNING": ["UMIR_4.1", "MIFID_II_ART12"], "MOMENTUM_IGNITION": ["UMIR_2.2", "MIFID_II_ART12"],
        "MARKING_THE_CLOSE": ["UMIR_2.2", "MIFID_II_ART12"]}

US, RS, NUL = "chr(31)", "chr(30)", "chr(0)"


def f8(x: str) -> str:
    return f"printf('%.8f', {x})"


def alert_ctes(src: str = "gold", name: str = "alerts", created_at: int = 0,
               rules: dict[str, tuple[str, float, list[str]]] | None = None) -> list[str]:
    """Alerts of the five detectors and of further ``rules`` (name -> score, threshold, references)."""
    rules = {n: (SCORES[n], THRESHOLDS[n], REFS[n]) for n in SCORES} | (rules or {})
    cand = " UNION ALL ".join(
        f"SELECT trader_id, symbol, window_start, window_end, desk, '{n}' AS detector, {score} AS rule_score, "
        f"{d(least)} AS threshold, {_lit(refs)} AS regulation_refs FROM {src}" for n, (score, least, refs) in rules.items())
    aid_body = f"detector || {US} || trader_id || {US} || symbol || {US} || CAST(window_start AS VARCHAR) || {US} || " \
               f"CAST(window_end AS VARCHAR)"
    return [
        f"{name}_c AS (SELECT * FROM ({cand}) WHERE rule_score >= threshold)",
        f"""{name}_i AS (
  SELECT *, sha256({aid_body}) AS _h,
         CAST(least(5, greatest(1, 1, CAST(ceil(rule_score * {d(5)}) AS BIGINT))) AS INTEGER) AS severity
  FROM {name}_c)""",
        f"""{name}_j AS (
  SELECT substr(_h, 1, 8) || '-' || substr(_h, 9, 4) || '-' || substr(_h, 13, 4) || '-' || substr(_h, 17, 4)
           || '-' || substr(_h, 21, 12) AS alert_id,
         detector, trader_id, symbol AS instrument, window_start, window_end, severity, rule_score,
         CAST(NULL AS DOUBLE) AS ml_score, regulation_refs, desk, CAST({created_at} AS BIGINT) AS created_at
  FROM {name}_i)""",
        f"""{name} AS (
  SELECT *, alert_id || {US} || detector || {US} || trader_id || {US} || instrument || {US}
           || CAST(window_start AS VARCHAR) || {US} || CAST(window_end AS VARCHAR) || {US}
           || CAST(severity AS VARCHAR) || {US} || {f8('rule_score')} || {US} || {NUL} || {US} || '' || {US}
           || array_to_string(regulation_refs, {RS}) || {US} || desk || {US} || CAST(created_at AS VARCHAR)
           AS _body
  FROM {name}_j)""",
    ]


def with_ctes(ctes: list[str], select: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(ctes) + "\n" + select


def base() -> list[str]:
    return feed_ctes() + medallion_ctes() + alert_ctes("gold", "alerts") + alert_ctes("gold_d", "alerts_d")


ALERT_REPORT = ("alert_id, detector, trader_id, instrument, window_start, window_end, severity, rule_score, "
                "ml_score, array_to_string(regulation_refs, ',') AS regulation_refs, desk, created_at, "
                "sha256(_body) AS audit_hash")

GOLD_COLS = ("trader_id, symbol, window_start, desk, asset_class, n_orders, n_cancels, n_execs, buy_qty, sell_qty, "
             "distinct_prices, secs_to_close, first_px, last_px, min_px, max_px, buy_vwap, sell_vwap, window_end, "
             "cancel_ratio, order_to_trade_ratio, qty_imbalance, price_move_bps, round_trip_gain_bps")


N_CHAINS = 64
_HEX8 = "CAST('0x' || substr(sha256(ref_id), 1, 8) AS BIGINT)"
MERKLE_BLOCK = 16


def chain_ctes(n_chains: int = N_CHAINS) -> list[str]:
    """Audit entries from alerts, hash-bucketed chains, and the recursive link fold."""
    body = f"subsystem || {US} || action || {US} || ref_id || {US} || CAST(ts AS VARCHAR) || {US} || " \
           f"array_to_string(list_transform(payload, lambda x: coalesce(x, {NUL})), {US})"
    g = "repeat('0', 64)"
    return [
        "ent0 AS (SELECT 'detector' AS subsystem, 'ALERT_EMITTED' AS action, alert_id AS ref_id, created_at AS ts, "
        f"[detector, CAST(severity AS VARCHAR), {f8('rule_score')}, sha256(_body)] AS payload FROM alerts)",
        f"ent AS (SELECT *, CAST((ts - {pmod('ts', DAY_MS)}) // {DAY_MS} * {n_chains} + {pmod(_HEX8, n_chains)} AS BIGINT) "
        "AS chain_id FROM ent0)",
        f"seqd AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY chain_id ORDER BY ts, ref_id, action, subsystem, payload) "
        f"AS seq, {body} AS body FROM ent)",
        f"""chain(chain_id, seq, ref_id, prev_hash, entry_hash) AS (
  SELECT chain_id, seq, ref_id, {g}, sha256({g} || '|' || body) FROM seqd WHERE seq = 1
  UNION ALL
  SELECT s.chain_id, s.seq, s.ref_id, c.entry_hash, sha256(c.entry_hash || '|' || s.body)
  FROM chain c JOIN seqd s ON s.chain_id = c.chain_id AND s.seq = c.seq + 1)""",
    ]


def merkle_ctes(block: int = MERKLE_BLOCK) -> list[str]:
    import math
    depth = max(1, math.ceil(math.log2(block)))
    out = [f"mk0 AS (SELECT chain_id, CAST((seq - 1) // {block} AS BIGINT) AS block, list(entry_hash ORDER BY seq) AS a, "
           f"min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS n_leaves FROM chain GROUP BY 1, 2)"]
    lvl = ("list_transform(range(0, CAST(ceil(len(a) / 2) AS BIGINT)), lambda i: CASE WHEN 2 * i + 1 < len(a) "
           "THEN sha256(a[2 * i + 1] || a[2 * i + 2]) ELSE a[2 * i + 1] END)")
    for k in range(1, depth + 1):
        out.append(f"mk{k} AS (SELECT chain_id, block, first_seq, last_seq, n_leaves, {lvl} AS a FROM mk{k - 1})")
    out.append(f"merkle AS (SELECT chain_id, block, n_leaves, first_seq, last_seq, a[1] AS merkle_root FROM mk{depth})")
    return out


def inclusion_ctes(block: int = MERKLE_BLOCK) -> list[str]:
    """The sibling path of every entry, out of the levels of ``merkle_ctes``."""
    depth = max(1, (block - 1).bit_length())
    at = lambda k: f"((seq - first_seq) >> {k})"
    sib = [f"CASE WHEN {at(k)} % 2 = 1 THEN 'L' || mk{k}.a[{at(k)}] WHEN {at(k)} + 2 <= len(mk{k}.a) THEN 'R' || mk{k}.a[{at(k)} + 2] END" for k in range(depth)]
    joins = " ".join(f"JOIN (SELECT chain_id, block, a FROM mk{k}) mk{k} USING (chain_id, block)" for k in range(1, depth))
    return [f"leaf AS (SELECT chain_id, seq, CAST((seq - 1) // {block} AS BIGINT) AS block FROM chain)",
            f"proofs AS (SELECT chain_id, seq, block, merkle_root, array_to_string(list_filter([{', '.join(sib)}], lambda x: x IS NOT NULL), ',') AS path "
            f"FROM leaf JOIN (SELECT chain_id, block, first_seq, a FROM mk0) mk0 USING (chain_id, block) "
            + joins + " JOIN (SELECT chain_id, block, merkle_root FROM merkle) r USING (chain_id, block))"]


def consistency_ctes(depth: int = 20) -> list[str]:
    """Ranges of a consistency proof by level, and roots of ranges by halving lists of hashes."""
    up = ("list_transform(range(0, CAST(ceil(len(a) / 2) AS BIGINT)), lambda i: CASE WHEN 2 * i + 1 < len(a) "
          "THEN sha256(a[2 * i + 1] || a[2 * i + 2]) ELSE a[2 * i + 1] END)")
    out = [
        "cl AS MATERIALIZED (SELECT chain_id, list(entry_hash ORDER BY seq) AS a, count(*) AS n, CAST(floor(count(*) * 2 / 3) AS BIGINT) + 1 AS m FROM chain GROUP BY 1)",
        "lv AS (SELECT chain_id, m, n, k, 1 << k AS u, (m - 1) >> k AS mine, (n - 1) >> k AS last, m % (1 << k) = 0 AS whole "
        f"FROM cl, (SELECT unnest(range(0, {depth})) AS k) t WHERE n >= m)",
        # the subtree that ends at m is the largest power of two that divides it
        "rg AS (SELECT chain_id, m, n, -1 AS step, m - max(u) AS lo, m AS hi FROM lv WHERE whole GROUP BY chain_id, m, n "
        "UNION ALL SELECT lv.chain_id, lv.m, lv.n, k, CASE WHEN mine % 2 = 1 THEN (mine - 1) * u ELSE (mine + 1) * u END, "
        "CASE WHEN mine % 2 = 1 THEN mine * u ELSE least(lv.n, (mine + 2) * u) END FROM lv "
        "JOIN (SELECT chain_id, max(u) AS t FROM lv WHERE whole GROUP BY 1) s USING (chain_id) WHERE u >= t AND (mine % 2 = 1 OR mine < last) "
        "UNION ALL SELECT chain_id, m, n, -2, 0, m FROM cl UNION ALL SELECT chain_id, m, n, -3, 0, n FROM cl)",
        "h0 AS MATERIALIZED (SELECT rg.chain_id, rg.m, rg.n, step, cl.a[lo + 1:hi] AS a FROM rg JOIN cl USING (chain_id))",
    ]
    for k in range(1, depth // 2 + 1):
        out.append(f"h{k} AS MATERIALIZED (SELECT chain_id, m, n, step, {up} AS a FROM h{k - 1})")
    out.append(f"consistency AS (SELECT chain_id, m, n, max(CASE WHEN step = -2 THEN a[1] END) AS old_root, max(CASE WHEN step = -3 THEN a[1] END) AS new_root, "
               f"array_to_string(list(a[1] ORDER BY step) FILTER (WHERE step >= -1), ',') AS proof FROM h{depth // 2} GROUP BY 1, 2, 3)")
    return out
