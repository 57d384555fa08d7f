"""Rules written in SQL: a typed SQL function per rule, usable in SQL text and as a detector.

``define`` creates ``rule_<name>`` as a temporary SQL function over gold columns. Catalyst inlines its body, so a rule
costs what the built-in expressions cost: no UDF, no join, no shuffle. The returned detector is given to
``detectors.detect`` beside names of the registry; the registry itself does not change.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from surveil.operators.detectors import Detector
from surveil.schemas import FEATURES

# Feature types of the gold layer; a rule's signature is made of these names.
_COUNTS = {"n_orders", "n_cancels", "n_execs", "buy_qty", "sell_qty", "distinct_prices"}
TYPES = {f: "BIGINT" if f in _COUNTS else "DOUBLE" for f in FEATURES} | {
    c: "DOUBLE" for c in ("first_px", "last_px", "min_px", "max_px", "buy_vwap", "sell_vwap")}


def define(spark: SparkSession, name: str, features: list[str], body: str, threshold: float,
           regulation_refs: tuple[str, ...]) -> Detector:
    """Create (or replace) the function ``rule_<name>(features) RETURNS DOUBLE`` and return its detector.

    ``body`` is a SQL expression over ``features``; a feature that it names but does not declare is an analysis
    error here, not at the first query. A NULL score gives no alert."""
    if not re.fullmatch(r"[A-Z][A-Z0-9_]*", name):
        raise ValueError(f"not a rule name: {name!r}")
    unknown = [f for f in features if f not in TYPES]
    if unknown:
        raise ValueError(f"not gold columns: {unknown}")
    function = f"rule_{name.lower()}"
    signature = ", ".join(f"{f} {TYPES[f]}" for f in features)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {function}({signature}) RETURNS DOUBLE RETURN {body}")
    return Detector(name, lambda: F.expr(f"{function}({', '.join(features)})"), threshold, tuple(regulation_refs))
