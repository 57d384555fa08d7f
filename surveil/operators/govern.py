"""Governance: PII masking and alert contract checks, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveil.schemas import ALERT_SCHEMA, DESKS, DETECTORS, DIRECTIONS


def mask(c: Column, key: str, prefix: str = "TRD-") -> Column:
    """Keyed pseudonym: HMAC-SHA-256 construction over the value, whole digest.

    Stable per value and key, so joins still work. Whoever holds the key can test a guessed value;
    without it the digest says nothing, so the key must be secret and at least 16 characters."""
    if len(key) < 16:
        raise ValueError("a pseudonym key needs at least 16 characters")
    inner, outer = F.sha2(F.lit(key + "|inner"), 256), F.sha2(F.lit(key + "|outer"), 256)
    return F.when(c.isNotNull(), F.concat(F.lit(prefix), F.sha2(F.concat(outer, F.sha2(F.concat(inner, c), 256)), 256)))


def masked_alerts(alerts: DataFrame, key: str) -> DataFrame:
    """Alerts with the trader pseudonymised. The alert id is re-keyed and the audit digest left out:
    both are hashes of the clear trader id, from which it could be found by trying every id."""
    return alerts.withColumns({"trader_id": mask(F.col("trader_id"), key),
                               "alert_id": mask(F.col("alert_id"), key, "ALT-")}).drop("audit_hash")


def masked_events(events: DataFrame, key: str) -> DataFrame:
    """Events with trader and account pseudonymised."""
    return events.withColumns({"trader_id": mask(F.col("trader_id"), key),
                               "account": mask(F.col("account"), key, "ACC-")})


def alert_violations(alerts: DataFrame) -> DataFrame:
    """Per alert, the names of the contract rules it breaks (empty array when valid).

    Enums (detector, desk, direction), severity 1..5, rule_score / ml_score in [0,1],
    feature rank >= 1, non-null required fields.
    """
    c = F.col
    checks = [
        ("detector_enum", ~c("detector").isin(*DETECTORS)),
        ("desk_enum", ~c("desk").isin(*DESKS)),
        ("severity_range", (c("severity") < 1) | (c("severity") > 5)),
        ("rule_score_range", (c("rule_score") < 0.0) | (c("rule_score") > 1.0)),
        ("ml_score_range", c("ml_score").isNotNull() & ((c("ml_score") < 0.0) | (c("ml_score") > 1.0))),
        ("shap_rank", F.exists(c("shap_top_features"), lambda x: x["rank"] < 1)),
        ("shap_direction", F.exists(c("shap_top_features"), lambda x: ~x["direction"].isin(*DIRECTIONS))),
        ("audit_hash_format", ~c("audit_hash").rlike("^[0-9a-f]{64}$")),
        ("alert_id_format", ~c("alert_id").rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")),
        ("window_order", c("window_end") <= c("window_start")),
    ]
    checks += [(f"null_{f.name}", c(f.name).isNull()) for f in ALERT_SCHEMA.fields if not f.nullable]
    arr = F.filter(F.array(*[F.when(F.coalesce(cond, F.lit(True)), F.lit(name)) for name, cond in checks]),
                   lambda x: x.isNotNull())
    return alerts.select("alert_id", "detector", arr.alias("violations"))


def schema_matches(df: DataFrame) -> bool:
    """Frozen contract: exact field names, types and order of the alert table."""
    return [(f.name, f.dataType) for f in df.schema.fields] == [(f.name, f.dataType) for f in ALERT_SCHEMA.fields]
