"""Rule detectors over gold windows and the alert emitter.

A detector is a registry entry ``name -> (score column, threshold, regulation refs)``;
a user adds one by registering another Column builder.  Emission is
Project -> Generate(explode) -> Filter -> Project after gold: narrow, codegen'd, no
join, no UDF, no shuffle.

Scores keep the operation order of the rule definitions (additions left to right,
double literals), so digits are reproducible across engines.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, NullType, StringType

from surveil.functions import grammar
from surveil.schemas import ALERT_COLS, FEATURE_CONTRIBUTION

c = F.col


def _d(x: float) -> Column:
    return F.lit(float(x))


# The weights, limits and order of operations of the five scores are the contract.

def spoofing_score() -> Column:
    ott = F.least(c("order_to_trade_ratio") / _d(10.0), _d(1.0))
    s = F.greatest(_d(0.0), F.least(_d(1.0), _d(0.7) * c("cancel_ratio") + _d(0.3) * ott))
    return F.when(c("n_orders") < 4, _d(0.0)).otherwise(s)


def wash_trade_score() -> Column:
    gate = ((c("buy_qty") <= 0) | (c("sell_qty") <= 0) | (c("n_execs") < 2)
            | (F.abs(c("qty_imbalance")) > _d(0.1)) | (F.abs(c("round_trip_gain_bps")) > _d(1.0)))
    balance = _d(1.0) - F.least(F.abs(c("qty_imbalance")), _d(1.0))
    concentration = F.when(c("distinct_prices") <= 2, _d(1.0)).otherwise(_d(0.5))
    s = F.greatest(_d(0.0), F.least(_d(1.0), _d(0.6) * balance + _d(0.4) * concentration))
    return F.when(gate, _d(0.0)).otherwise(s)


def front_running_score() -> Column:
    gate = ((c("n_execs") < 2) | (F.abs(c("qty_imbalance")) > _d(0.1)) | (c("round_trip_gain_bps") <= _d(1.0))
            | (c("buy_qty") <= 0) | (c("sell_qty") <= 0))
    s = F.least(_d(1.0), _d(0.6) + _d(0.4) * F.least(c("round_trip_gain_bps") / _d(10.0), _d(1.0)))
    return F.when(gate, _d(0.0)).otherwise(s)


def momentum_score() -> Column:
    gate = ((c("n_execs") < 4) | (c("price_move_bps") <= _d(0.0)) | (c("cancel_ratio") > _d(0.2))
            | (c("sell_qty") <= 0))
    fill_intensity = F.least(c("n_execs") / _d(6.0), _d(1.0))
    move_confirm = F.least(c("price_move_bps") / _d(5.0), _d(1.0))
    s = F.least(_d(1.0), _d(0.4) * fill_intensity + _d(0.3) + _d(0.1) * move_confirm)
    return F.when(gate, _d(0.0)).otherwise(s)


def marking_close_score(close_window_secs: float = 120.0) -> Column:
    stc = c("secs_to_close")
    gate = ((stc < _d(0.0)) | (stc > _d(close_window_secs)) | (c("price_move_bps") <= _d(0.0))
            | (c("n_execs") < 1) | (c("buy_qty") <= 0))
    proximity = _d(1.0) - F.least(stc / _d(close_window_secs), _d(1.0))
    escalation = F.least(c("price_move_bps") / _d(5.0), _d(1.0))
    at_high = F.when((c("last_px") >= c("max_px") - _d(1e-9)) & (c("max_px") > 0), _d(1.0)).otherwise(_d(0.5))
    s = F.least(_d(1.0), _d(0.3) + _d(0.3) * proximity + _d(0.2) * escalation + _d(0.2) * at_high)
    return F.when(gate, _d(0.0)).otherwise(s)


@dataclass(frozen=True)
class Detector:
    name: str
    score: Callable[[], Column]
    threshold: float
    regulation_refs: tuple[str, ...]


# Detector names, thresholds and regulation tokens.
REGISTRY: dict[str, Detector] = {
    "SPOOFING": Detector("SPOOFING", spoofing_score, 0.5, ("UMIR_2.2", "MIFID_II_ART12")),
    "WASH_TRADE": Detector("WASH_TRADE", wash_trade_score, 0.6, ("UMIR_2.2", "MIFID_II_ART12")),
    "FRONT_RUNNING": Detector("FRONT_RUNNING", front_running_score, 0.5, ("UMIR_4.1", "MIFID_II_ART12")),
    "MOMENTUM_IGNITION": Detector("MOMENTUM_IGNITION", momentum_score, 0.5, ("UMIR_2.2", "MIFID_II_ART12")),
    "MARKING_THE_CLOSE": Detector("MARKING_THE_CLOSE", marking_close_score, 0.5, ("UMIR_2.2", "MIFID_II_ART12")),
}


def register(det: Detector) -> None:
    REGISTRY[det.name] = det


def chosen(names: list[str | Detector] | None = None) -> list[Detector]:
    """Detectors by registry name or given as such; all of the registry by default."""
    return [n if isinstance(n, Detector) else REGISTRY[n] for n in names or list(REGISTRY)]


def score_all(gold: DataFrame, names: list[str | Detector] | None = None) -> DataFrame:
    """Gold + one ``score_<detector>`` double column per detector."""
    return gold.withColumns({f"score_{x.name.lower()}": x.score() for x in chosen(names)})


def candidates(gold: DataFrame, names: list[str | Detector] | None = None) -> DataFrame:
    """explode(array(struct(detector, score, threshold, refs))) over gold, scores >= threshold kept."""
    arr = F.array(*[F.struct(F.lit(x.name).alias("detector"), x.score().alias("rule_score"),
                             F.lit(x.threshold).alias("threshold"),
                             F.array(*[F.lit(r) for r in x.regulation_refs]).alias("regulation_refs"))
                    for x in chosen(names)])
    # scores are projected before the generator: SQL functions may not stand inside it
    scored = gold.select("trader_id", "symbol", "window_start", "window_end", "desk", arr.alias("d"))
    return (scored.withColumn("d", F.explode("d"))
            .select("trader_id", "symbol", "window_start", "window_end", "desk", "d.*")
            .filter(c("rule_score") >= c("threshold")))


def emit(cand: DataFrame, created_at: int | Column = 0) -> DataFrame:
    """Candidates -> canonical alerts (id, severity, digest over the 13 hash fields)."""
    created = created_at if isinstance(created_at, Column) else F.lit(created_at)
    a = cand.select(
        grammar.alert_id(c("detector"), c("trader_id"), c("symbol"), c("window_start"), c("window_end"))
        .alias("alert_id"),
        "detector", "trader_id", c("symbol").alias("instrument"), "window_start", "window_end",
        grammar.severity(c("rule_score")).alias("severity"),
        "rule_score",
        F.lit(None).cast("double").alias("ml_score"),
        F.array().cast(ArrayType(FEATURE_CONTRIBUTION)).alias("shap_top_features"),
        F.array().cast("array<string>").alias("triggering_event_ids"),
        F.col("regulation_refs").cast("array<string>").alias("regulation_refs"), "desk",
        created.cast("long").alias("created_at"),
    )
    body = grammar.canonical_body([
        (c("alert_id"), StringType()), (c("detector"), StringType()), (c("trader_id"), StringType()),
        (c("instrument"), StringType()), (c("window_start"), LongType()), (c("window_end"), LongType()),
        (c("severity"), LongType()), (c("rule_score"), DoubleType()), (F.lit(None), NullType()),
        (F.array().cast("array<string>"), ArrayType(StringType())),
        (c("regulation_refs"), ArrayType(StringType())), (c("desk"), StringType()),
        (c("created_at"), LongType()),
    ])
    return a.withColumn("audit_hash", grammar.digest(body)).select(*ALERT_COLS)


def alert_body(alerts: DataFrame) -> Column:
    """Canonical body of an emitted alert, ml_score and event ids as stored."""
    types = {f.name: f.dataType for f in alerts.schema.fields}
    from surveil.schemas import ALERT_HASH_FIELD_ORDER
    return grammar.canonical_body([(c(n), types[n]) for n in ALERT_HASH_FIELD_ORDER])


def detect(gold: DataFrame, names: list[str | Detector] | None = None, created_at: int | Column = 0) -> DataFrame:
    return emit(candidates(gold, names), created_at)
