"""Small, fixed dimension tables: instruments, trader ids and scenario templates.

All of them have a proven size bound (they are literals), so they are the only
tables this library ever broadcasts without a size check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (instrument universe and trader pools of the reference model).
# ---------------------------------------------------------------------------
# symbol, exchange, mid price in cents, tick in cents
INSTRUMENTS = [
    ("RY", "TSX", 14000, 1),
    ("TD", "TSX", 8000, 1),
    ("BNS", "TSX", 6500, 1),
    ("BMO", "TSX", 12500, 1),
    ("CM", "TSX", 6000, 1),
    ("XIU", "TSX", 3300, 1),
]
N_BENIGN_TRADERS = 20   # T-000 .. T-019, account ACC-<trader>
N_ABUSIVE_TRADERS = 5   # A-000 .. A-004, account ACC-<trader>

ARCHETYPES = ["SPOOFING", "WASH_TRADE", "FRONT_RUNNING", "MOMENTUM_IGNITION", "MARKING_THE_CLOSE"]

# ---------------------------------------------------------------------------
# Scenario templates: one row per emitted event, built from the archetype parameters.
# who: A = abuser, C = the front-running client. ticks: price offset from mid in ticks
# (None = no price). dt: ms after t0. sfx: cl_ord_id suffix. orig: suffix of the order a
# cancel refers to. oid / eid: order / execution id suffixes of fills. Random
# quantities of the reference are replaced by fixed values inside their ranges.
# ---------------------------------------------------------------------------
# Fixed values (timing in ms, quantities) of the archetypes.
SPOOF_QTY, SPOOF_LAYER_GAP, SPOOF_SELL_QTY, SPOOF_SELL_DT, SPOOF_FILL_DT, SPOOF_CANCEL_DT, SPOOF_CANCEL_GAP = \
    5000, 50, 200, 300, 350, 400, 20
WASH_SELL_DT, WASH_FILL_DT = 100, 150
FR_ABUSER_QTY, FR_BUY_DT, FR_BUY_FILL_DT, FR_CLIENT_FILL_DT, FR_SELL_DT, FR_SELL_FILL_DT, FR_EXIT_TICKS = \
    600, 50, 100, 200, 300, 350, 10
MOM_QTY, MOM_GAP, MOM_FILL_LAG, MOM_EXIT_PAUSE, MOM_EXIT_FILL_LAG = 250, 80, 20, 150, 30
MTC_QTY, MTC_GAP, MTC_FILL_LAG, MTC_CANCEL_LAG, MTC_CANCEL_GAP = 600, 15_000, 500, 200, 50

TEMPLATE_COLUMNS = ["archetype", "step", "t_msg", "who", "t_side", "t_qty", "t_ord_type", "ticks",
                    "dt", "sfx", "orig_sfx", "oid_sfx", "eid_sfx", "reason"]
TEMPLATE_DDL = ("archetype string, step int, t_msg string, who string, t_side string, t_qty bigint, "
                "t_ord_type string, ticks int, dt bigint, sfx string, orig_sfx string, oid_sfx string, "
                "eid_sfx string, reason string")
LABEL_TEMPLATE_DDL = "archetype string, end_dt bigint, id_sfx array<string>"


def build_templates(layers: int = 4, wash_qty: int = 1000, client_qty: int = 10_000, burst_size: int = 5,
                    exit_qty: int = 2000, waves: int = 3) -> tuple[list[tuple], list[tuple]]:
    """(event template rows, label template rows) for the five archetypes."""
    ev: list[tuple] = []

    def add(arch, msg, who, side, qty, ord_type, ticks, dt, sfx, orig=None, oid=None, eid=None, reason=None):
        step = sum(1 for r in ev if r[0] == arch)
        ev.append((arch, step, msg, who, side, qty, ord_type, ticks, dt, sfx, orig, oid, eid, reason))

    a = "SPOOFING"
    for i in range(layers):
        add(a, "D", "A", "1", SPOOF_QTY, "2", -(i + 1), SPOOF_LAYER_GAP * i, f"spoof-{i}")
    add(a, "D", "A", "2", SPOOF_SELL_QTY, "2", 0, SPOOF_SELL_DT, "genuine-sell")
    add(a, "8", "A", "2", SPOOF_SELL_QTY, "2", 0, SPOOF_FILL_DT, "genuine-sell", oid="oid", eid="eid")
    for i in range(layers):
        add(a, "F", "A", "1", SPOOF_QTY, "2", None, SPOOF_CANCEL_DT + SPOOF_CANCEL_GAP * i, f"cancel-{i}",
            orig=f"spoof-{i}", reason="SPOOF_CANCEL")
    spoof_end = SPOOF_CANCEL_DT + SPOOF_CANCEL_GAP * layers
    spoof_ids = [f"spoof-{i}" for i in range(layers)] + [f"cancel-{i}" for i in range(layers)] + ["genuine-sell"]

    a = "WASH_TRADE"
    add(a, "D", "A", "1", wash_qty, "2", 0, 0, "wash-buy")
    add(a, "D", "A", "2", wash_qty, "2", 0, WASH_SELL_DT, "wash-sell")
    add(a, "8", "A", "1", wash_qty, "2", 0, WASH_FILL_DT, "wash-buy", oid="boid", eid="beid")
    add(a, "8", "A", "2", wash_qty, "2", 0, WASH_FILL_DT, "wash-sell", oid="soid", eid="seid")

    a = "FRONT_RUNNING"
    add(a, "D", "C", "1", client_qty, "1", None, 0, "client-buy")
    add(a, "D", "A", "1", FR_ABUSER_QTY, "2", 0, FR_BUY_DT, "abuser-buy")
    add(a, "8", "A", "1", FR_ABUSER_QTY, "2", 0, FR_BUY_FILL_DT, "abuser-buy", oid="abuser-oid", eid="abuser-eid")
    add(a, "8", "C", "1", client_qty, "1", 0, FR_CLIENT_FILL_DT, "client-buy", oid="client-oid", eid="client-eid")
    add(a, "D", "A", "2", FR_ABUSER_QTY, "2", FR_EXIT_TICKS, FR_SELL_DT, "abuser-sell")
    add(a, "8", "A", "2", FR_ABUSER_QTY, "2", FR_EXIT_TICKS, FR_SELL_FILL_DT, "abuser-sell",
        oid="abuser-exit-oid", eid="abuser-exit-eid")

    a = "MOMENTUM_IGNITION"
    for i in range(burst_size):
        add(a, "D", "A", "1", MOM_QTY, "2", i + 1, MOM_GAP * i, f"burst-{i}")
        add(a, "8", "A", "1", MOM_QTY, "2", i + 1, MOM_GAP * i + MOM_FILL_LAG, f"burst-{i}",
            oid=f"boid-{i}", eid=f"beid-{i}")
    t_exit = MOM_GAP * burst_size + MOM_EXIT_PAUSE
    add(a, "D", "A", "2", exit_qty, "2", burst_size, t_exit, "exit-sell")
    add(a, "8", "A", "2", exit_qty, "2", burst_size, t_exit + MOM_EXIT_FILL_LAG, "exit-sell", oid="soid", eid="seid")

    a = "MARKING_THE_CLOSE"
    for i in range(waves):
        add(a, "D", "A", "1", MTC_QTY, "2", i + 1, MTC_GAP * i, f"mtc-{i}")
    t_fill = MTC_GAP * (waves - 1) + MTC_FILL_LAG
    add(a, "8", "A", "1", MTC_QTY, "2", waves, t_fill, f"mtc-{waves - 1}", oid="oid", eid="eid")
    for i in range(waves - 1):
        add(a, "F", "A", "1", MTC_QTY, "2", None, t_fill + MTC_CANCEL_LAG + MTC_CANCEL_GAP * i, f"mtc-cancel-{i}",
            orig=f"mtc-{i}", reason="POST_CLOSE_CLEANUP")
    mtc_end = t_fill + MTC_CANCEL_LAG + max(waves - 2, 0) * MTC_CANCEL_GAP

    labels = [
        ("SPOOFING", spoof_end, spoof_ids),
        ("WASH_TRADE", WASH_FILL_DT, ["wash-buy", "wash-sell"]),
        ("FRONT_RUNNING", FR_SELL_FILL_DT, ["abuser-buy"]),
        ("MOMENTUM_IGNITION", t_exit + MOM_EXIT_FILL_LAG, [f"burst-{i}" for i in range(burst_size)] + ["exit-sell"]),
        # the last wave id appears twice, as the label lists the waves and then the filled order
        ("MARKING_THE_CLOSE", mtc_end, [f"mtc-{i}" for i in range(waves)] + [f"mtc-{waves - 1}"]),
    ]
    return ev, labels


TEMPLATES, LABEL_TEMPLATES = build_templates()


def templates(spark: SparkSession, **params) -> DataFrame:
    """Event templates (defaults, or archetype parameters such as layers=6, waves=5)."""
    return spark.createDataFrame(build_templates(**params)[0] if params else TEMPLATES, TEMPLATE_DDL)


def label_templates(spark: SparkSession, **params) -> DataFrame:
    return spark.createDataFrame(build_templates(**params)[1] if params else LABEL_TEMPLATES, LABEL_TEMPLATE_DDL)


def asset_classes(spark: SparkSession, rows: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """Optional symbol -> (asset_class, desk) dimension; empty means everything is equity."""
    return spark.createDataFrame(rows or [], "symbol string, asset_class string, desk string")
