"""Composed plans: driver tables -> feed -> bronze -> silver -> gold -> alerts.

Each function returns a lazy DataFrame; nothing is materialised unless the caller
writes or collects.  Shared by the query registry, the bench and the tests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveil.operators import bronze as B
from surveil.operators import detectors as D
from surveil.operators import gold as G
from surveil.operators import silver as S
from surveil.schemas import DEDUP_KEY
from surveil.session import stored
from surveil.sources import feed

DAILY_MS = 86_400_000
CREATED_AT = 0  # alerts are emitted with a fixed created_at so digests are reproducible


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.raw_feed(spark, sf_dir)


def bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.to_bronze(raw(spark, sf_dir))


def silver(spark: SparkSession, sf_dir: str, needed: list[str] | None = None) -> DataFrame:
    """``needed``: the bronze columns that are read behind it (all by default)."""
    return S.to_silver(bronze(spark, sf_dir), needed=needed, sift=True)


def stored_silver(spark: SparkSession, sf_dir: str, needed: list[str] | None = None) -> DataFrame:
    """Silver written once to the shared folder: for plans that read it more than once.

    With ``needed`` (bronze columns) it holds the dedup key, these and what ``enrich`` adds, save the notional."""
    if needed is None:
        return stored(silver(spark, sf_dir), "silver")
    columns = [*DEDUP_KEY, *[c for c in needed if c not in DEDUP_KEY], "event_kind", "is_buy", *S.UNMAPPED]
    return stored(silver(spark, sf_dir, needed).select(*columns), "silver")


def gold_of(silver_: DataFrame, window_ms: int = 60_000) -> DataFrame:
    """Gold of a silver table that ``silver`` made: desk and asset class are not mapped there."""
    return G.to_gold(silver_, window_ms, constant=S.UNMAPPED)


def alerts_of(silver_: DataFrame, window_ms: int = 60_000) -> DataFrame:
    return D.detect(gold_of(silver_, window_ms), None, CREATED_AT)


def gold(spark: SparkSession, sf_dir: str, window_ms: int = 60_000) -> DataFrame:
    return gold_of(silver(spark, sf_dir, G.INPUT_COLUMNS), window_ms)


def alerts(spark: SparkSession, sf_dir: str, window_ms: int = 60_000,
           detectors: list[str] | None = None) -> DataFrame:
    return D.detect(gold(spark, sf_dir, window_ms), detectors, CREATED_AT)


def alerts_report(a: DataFrame) -> DataFrame:
    """Flat projection of the alert table (list columns joined, constant-empty lists omitted)."""
    return a.select("alert_id", "detector", "trader_id", "instrument", "window_start", "window_end",
                    "severity", "rule_score", "ml_score",
                    F.array_join("regulation_refs", ",").alias("regulation_refs"),
                    "desk", "created_at", "audit_hash")
