"""Fixed schemas, column orders and domain constants.

Everything in this module is a contract: changing a field name, type or order changes
digests, ids or downstream joins.
"""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference contract (do not reorder).
# ---------------------------------------------------------------------------

# Raw FIX event fields, in contract order; all nullable.
RAW_FIX_FIELDS = [
    ("msg_type", StringType()),
    ("cl_ord_id", StringType()),
    ("trader_id", StringType()),
    ("account", StringType()),
    ("symbol", StringType()),
    ("side", StringType()),
    ("order_qty", LongType()),
    ("ord_type", StringType()),
    ("transact_time", LongType()),
    ("exchange_id", StringType()),
    ("price", DoubleType()),
    ("exec_type", StringType()),
    ("order_id", StringType()),
    ("exec_id", StringType()),
    ("last_qty", LongType()),
    ("last_px", DoubleType()),
    ("orig_cl_ord_id", StringType()),
    ("cancel_reason", StringType()),
    ("scenario_id", StringType()),
    ("scenario_type", StringType()),
]

# Fields every well-formed event must carry (bronze not-null gate).
REQUIRED_BRONZE_FIELDS = [
    "msg_type", "cl_ord_id", "trader_id", "account", "symbol",
    "side", "order_qty", "ord_type", "transact_time", "exchange_id",
]

# Silver duplicate key (idempotent re-delivery); NULL equals NULL.
DEDUP_KEY = ["cl_ord_id", "msg_type", "transact_time", "exec_id"]

# FIX codes.
SIDE_BUY, SIDE_SELL = "1", "2"
MSG_NEW, MSG_EXEC, MSG_CANCEL, MSG_REPLACE = "D", "8", "F", "G"
ORD_MARKET, ORD_LIMIT = "1", "2"

# msg_type -> event_kind (anything else is OTHER).
EVENT_KINDS = [("D", "NEW"), ("8", "EXEC"), ("F", "CANCEL"), ("G", "REPLACE")]

# Gold window and session constants (epoch millis, UTC-naive session).
DEFAULT_WINDOW_MS = 60_000
DAY_MS = 86_400_000
CLOSE_MS_OF_DAY = 57_600_000  # 16:00 session close

# Range in which gold sums are exact; the bronze gate quarantines rows outside it.
PRICE_LIMIT = 1e9             # |price|, |last_px| below this, and finite
QTY_LIMIT = 10 ** 10          # |order_qty|, |last_qty| below this

# Detector names and desks (alert enums).
DETECTORS = ["SPOOFING", "WASH_TRADE", "FRONT_RUNNING", "MOMENTUM_IGNITION", "MARKING_THE_CLOSE"]
DESKS = ["equity", "derivatives"]
DIRECTIONS = ["increases", "decreases"]

# Model feature columns, in order.
FEATURES = [
    "n_orders", "n_cancels", "n_execs", "buy_qty", "sell_qty", "distinct_prices",
    "cancel_ratio", "order_to_trade_ratio", "qty_imbalance", "price_move_bps",
    "round_trip_gain_bps", "secs_to_close",
]

# Alert fields that enter the audit digest, in order (omits shap_top_features, audit_hash).
ALERT_HASH_FIELD_ORDER = [
    "alert_id", "detector", "trader_id", "instrument", "window_start", "window_end",
    "severity", "rule_score", "ml_score", "triggering_event_ids", "regulation_refs",
    "desk", "created_at",
]

# Byte grammar separators and the chain genesis.
US = "\x1f"   # between fields
RS = "\x1e"   # between list elements
NUL = "\x00"  # null marker
GENESIS_HASH = "0" * 64

# Medallion namespaces: one catalog, seven schemas.
NAMESPACES = ("bronze", "silver", "gold", "alerts", "governed_output", "eval", "ml")

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference contract: struct types (do not reorder).
# ---------------------------------------------------------------------------

RAW_FIX_SCHEMA = StructType([StructField(n, t, True) for n, t in RAW_FIX_FIELDS])

FEATURE_CONTRIBUTION = StructType([
    StructField("feature_name", StringType(), False),
    StructField("feature_value", DoubleType(), False),
    StructField("shap_value", DoubleType(), False),
    StructField("rank", IntegerType(), False),
    StructField("direction", StringType(), False),
])

ALERT_SCHEMA = StructType([
    StructField("alert_id", StringType(), False),
    StructField("detector", StringType(), False),
    StructField("trader_id", StringType(), False),
    StructField("instrument", StringType(), False),
    StructField("window_start", LongType(), False),
    StructField("window_end", LongType(), False),
    StructField("severity", IntegerType(), False),
    StructField("rule_score", DoubleType(), False),
    StructField("ml_score", DoubleType(), True),
    StructField("shap_top_features", ArrayType(FEATURE_CONTRIBUTION), False),
    StructField("triggering_event_ids", ArrayType(StringType()), False),
    StructField("regulation_refs", ArrayType(StringType()), False),
    StructField("desk", StringType(), False),
    StructField("created_at", LongType(), False),
    StructField("audit_hash", StringType(), False),
])
ALERT_COLS = [f.name for f in ALERT_SCHEMA.fields]

LABEL_SCHEMA = StructType([
    StructField("scenario_id", StringType(), False),
    StructField("abuse_type", StringType(), False),
    StructField("trader_id", StringType(), False),
    StructField("instrument", StringType(), False),
    StructField("window_start", LongType(), False),
    StructField("window_end", LongType(), False),
    StructField("injected_event_ids", ArrayType(StringType()), False),
])
