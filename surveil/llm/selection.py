"""Exact distributed selection: the k-th largest value of a column."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 4096              # bins per level: what the driver sees at a time
SMALL = 10_000           # a bin of at most this many distinct values is read whole


def kth_largest(df: DataFrame, column: str, k: int) -> float | None:
    """k-th largest finite value (1 = largest) of a double column; None if there are fewer than k.

    Each level counts rows in BINS equal bins between the current bounds (partial aggregation, at
    most BINS rows reach the driver) and goes on inside the bin that holds the k-th value, until
    that bin holds few distinct values. Works on (value, count), so repeated values cost nothing.
    """
    counts = df.select(F.col(column).cast("double").alias("x")).filter("x is not null and not isnan(x) and abs(x) < double('Infinity')")
    counts = counts.groupBy("x").agg(F.count("*").alias("n"))
    lo, hi, total = counts.agg(F.min("x"), F.max("x"), F.sum("n")).first()
    if k < 1 or not total or total < k:
        return None
    while True:
        inside = counts.filter((F.col("x") >= lo) & (F.col("x") <= hi))
        width = (hi - lo) / BINS
        if lo < hi and width > 0 and lo + width > lo:
            bin_ = F.least(F.floor((F.col("x") - lo) / width), F.lit(BINS - 1))
            rows = inside.groupBy(bin_.alias("b")).agg(
                F.sum("n").alias("n"), F.count("*").alias("d"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()
            for r in sorted(rows, key=lambda r: -r.b):
                if k <= r.n:
                    break
                k -= r.n
            if r.d > SMALL and (r.lo, r.hi) != (lo, hi):
                lo, hi = r.lo, r.hi
                continue
            inside = counts.filter((F.col("x") >= r.lo) & (F.col("x") <= r.hi))
        for r in inside.orderBy(F.desc("x")).limit(SMALL).collect():
            if k <= r.n:
                return r.x
            k -= r.n
        return math.nan
