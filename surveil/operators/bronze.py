"""Bronze: schema-enforced raw events with ingest metadata, a clean set and its quarantine.

The input is already a DataFrame in ``RAW_FIX_SCHEMA`` (a reader, never a driver-side
list).  One tagged DataFrame carries the names of the missing required fields, so the
clean set and the quarantine are two filters over the same plan and the not-null
predicate reaches the parquet scan when the source is columnar.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveil.schemas import (
    MSG_CANCEL,
    MSG_EXEC,
    MSG_NEW,
    MSG_REPLACE,
    PRICE_LIMIT,
    QTY_LIMIT,
    REQUIRED_BRONZE_FIELDS,
    SIDE_BUY,
    SIDE_SELL,
)

LIMITS = {"price": PRICE_LIMIT, "last_px": PRICE_LIMIT, "order_qty": QTY_LIMIT, "last_qty": QTY_LIMIT}


def required_not_null(fields: list[str] = REQUIRED_BRONZE_FIELDS) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in fields])


def out_of_range(field: str) -> Column:
    """True where a price or quantity is NaN, infinite or beyond its limit (a null is in range)."""
    c, limit = F.col(field), F.lit(LIMITS[field])
    # NaN sorts above every number, so the first comparison catches it as well
    return F.coalesce((c >= limit) | (c <= -limit), F.lit(False))


def clean() -> Column:
    """Every required field present and every number in range."""
    return reduce(lambda a, b: a & b, [~out_of_range(f) for f in LIMITS], required_not_null())


def missing_fields(fields: list[str] = REQUIRED_BRONZE_FIELDS) -> Column:
    """array<string>: required fields that are NULL, ``range:<field>`` for numbers out of range."""
    return F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in fields],
                            *[F.when(out_of_range(c), F.lit(f"range:{c}")) for c in LIMITS]),
                    lambda x: x.isNotNull())


def with_ingest_metadata(raw: DataFrame, ingest_ts: int = 0, source: str = "fix.local") -> DataFrame:
    return raw.withColumns({"_ingest_ts": F.lit(ingest_ts).cast("long"), "_source": F.lit(source)})


def tag(raw: DataFrame, ingest_ts: int = 0, source: str = "fix.local") -> DataFrame:
    """Raw rows + ingest metadata + ``_dq_missing``."""
    return with_ingest_metadata(raw, ingest_ts, source).withColumn("_dq_missing", missing_fields())


def to_bronze(raw: DataFrame, ingest_ts: int = 0, source: str = "fix.local") -> DataFrame:
    """Clean bronze: rows carrying every required field, numbers in range."""
    return with_ingest_metadata(raw, ingest_ts, source).filter(clean())


def bronze_quarantine(raw: DataFrame, ingest_ts: int = 0, source: str = "fix.local") -> DataFrame:
    """Exact complement of ``to_bronze``, with the names of the missing fields."""
    return tag(raw, ingest_ts, source).filter(~clean())


def dq_metrics(raw: DataFrame) -> DataFrame:
    """One global aggregate (partial per partition) -> (metric, value) rows.

    Counts rows, clean and quarantined rows, NULLs per required field, and domain
    problems the gate lets through (empty strings, unknown side / msg_type codes).
    """
    ok = clean()
    aggs = [F.count(F.lit(1)).alias("rows_total"),
            F.sum(F.when(ok, 1).otherwise(0)).alias("rows_clean"),
            F.sum(F.when(ok, 0).otherwise(1)).alias("rows_quarantined")]
    aggs += [F.sum(F.when(F.col(c).isNull(), 1).otherwise(0)).alias(f"null_{c}") for c in REQUIRED_BRONZE_FIELDS]
    strings = ["msg_type", "cl_ord_id", "trader_id", "account", "symbol", "side", "ord_type", "exchange_id"]
    aggs += [F.sum(F.when(F.col(c) == "", 1).otherwise(0)).alias(f"empty_{c}") for c in strings]
    aggs += [
        F.sum(F.when(~F.col("side").isin(SIDE_BUY, SIDE_SELL), 1).otherwise(0)).alias("bad_side"),
        F.sum(F.when(~F.col("msg_type").isin(MSG_NEW, MSG_EXEC, MSG_CANCEL, MSG_REPLACE), 1).otherwise(0))
        .alias("bad_msg_type"),
        F.sum(F.when(F.col("order_qty") <= 0, 1).otherwise(0)).alias("nonpositive_qty"),
    ]
    wide = raw.agg(*aggs)
    names = [c for c in wide.columns]
    stack = "stack({n}, {pairs}) as (metric, value)".format(
        n=len(names), pairs=", ".join(f"'{c}', coalesce(cast({c} as bigint), 0L)" for c in names))
    return wide.selectExpr(stack)
