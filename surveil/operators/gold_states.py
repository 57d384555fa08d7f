"""Mergeable gold states: one row per (gold keys, step window, price), merged to any coarser window.

A state row holds only values that merge by sum, min or max: counts, quantities, exact decimal
sums of paid amounts, the first and last time of its price.  The price is part of the key, so
distinct prices and the first / last price of a coarse window stay exact without a set per row:
every state row is fixed-width, and a hot window costs one row per price and map task.

States written by different jobs or batches may repeat a key; merging them is still right, as
long as each silver event went into exactly one of them.  Windows coarser than the step are read
from the states alone.

Defined cases: events without a price form a row with a null price, which no price feature
counts; an empty table gives no states and no windows; a price of -0.0 is stored as 0.0; other
columns are ignored.  Window and step must divide: anything else raises.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveil.operators import gold as G
from surveil.schemas import CLOSE_MS_OF_DAY, DEFAULT_WINDOW_MS

#: state column -> column of the gold aggregate that it sums
SUMS = {"n_orders": "n_orders", "n_cancels": "n_cancels", "n_execs": "n_execs", "buy_qty": "buy_qty", "sell_qty": "sell_qty",
        "buy_filled": "_bq", "buy_paid": "_bpaid", "sell_filled": "_sq", "sell_paid": "_spaid"}
STATE_KEYS = [*G.GROUP_KEYS, "price"]


def state_exprs() -> dict[str, Column]:
    """Aggregates of silver rows (with ``_stc``) that make a state row."""
    t = F.col("transact_time")
    whole = G.aggregate_exprs(F.lit(0))
    return {**{name: whole[source] for name, source in SUMS.items()}, "secs_to_close": F.min("_stc"),
            "first_time": F.min(t), "last_time": F.max(t)}


def _keys(constant: dict[str, str] | None) -> list[str]:
    """The state keys to group by, see ``gold.to_gold``."""
    return [k for k in STATE_KEYS if k not in (constant or {})]


def _with(df: DataFrame, constant: dict[str, str] | None) -> DataFrame:
    return df.withColumns({c: F.lit(v) for c, v in (constant or {}).items()})


def to_states(silver: DataFrame, step_ms: int = DEFAULT_WINDOW_MS, close_ms_of_day: int = CLOSE_MS_OF_DAY,
              constant: dict[str, str] | None = None) -> DataFrame:
    """States of ``silver`` per step window. ``constant``: keys with one value in every row, not grouped by."""
    G.check_window(step_ms)
    states = G.prepare(silver, step_ms, close_ms_of_day).groupBy(*_keys(constant)).agg(
        *[e.alias(n) for n, e in state_exprs().items()])
    return _with(states, constant).select(*STATE_KEYS, *state_exprs())


def _check(window_ms: int, step_ms: int) -> None:
    G.check_window(window_ms)
    G.check_window(step_ms)
    if window_ms % step_ms:
        raise ValueError(f"a window of {window_ms} ms is no multiple of the states' step of {step_ms} ms")


def _merged() -> dict[str, Column]:
    return {**{name: F.sum(name) for name in SUMS}, "secs_to_close": F.min("secs_to_close")}


def _coarser(states: DataFrame, window_ms: int) -> DataFrame:
    return states.withColumn("window_start", G.window_start(F.col("window_start"), window_ms))


def merge(states: DataFrame, window_ms: int, step_ms: int = DEFAULT_WINDOW_MS, constant: dict[str, str] | None = None) -> DataFrame:
    """States per ``window_ms`` from states per ``step_ms``: a coarser step, or the compaction of repeated keys."""
    _check(window_ms, step_ms)
    aggs = {**_merged(), "first_time": F.min("first_time"), "last_time": F.max("last_time")}
    merged = _coarser(states, window_ms).groupBy(*_keys(constant)).agg(*[e.alias(n) for n, e in aggs.items()])
    return _with(merged, constant).select(*states.columns)


def to_gold(states: DataFrame, window_ms: int, step_ms: int = DEFAULT_WINDOW_MS, constant: dict[str, str] | None = None) -> DataFrame:
    """The gold table per ``window_ms``, equal to ``gold.to_gold`` over the events behind the states.

    First per (window, price), then per window, as there: rows of sums and times ride through the first shuffle
    instead of the buffers of a distinct aggregate."""
    price = F.col("price")
    merged = merge(states, window_ms, step_ms, constant)

    def order(time: str) -> Column:
        return F.when(price.isNotNull(), G.time_price_key(F.col(time) - F.col("window_start"), price))
    aggs = {**{SUMS.get(n, n): e for n, e in _merged().items()}, "distinct_prices": F.count(price),
            "_first_px": F.min_by(price, order("first_time")), "_last_px": F.max_by(price, order("last_time")),
            "_min_px": F.min(price), "_max_px": F.max(price)}
    keys = [k for k in _keys(constant) if k != "price"]
    return G.derive(_with(merged.groupBy(*keys).agg(*[e.alias(n) for n, e in aggs.items()]), constant), window_ms)
