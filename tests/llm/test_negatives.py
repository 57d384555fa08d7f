import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from surveil.llm import negatives as N


def brute(rows, anchor, positives=5, negatives=5, low=80):
    """rows: (id, label, vector)."""
    ok = {}
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            key = (label, len(v), np.array([math.floor(256 * x) for x in v], np.int64).tobytes())
            ok[i] = min(ok.get(i, (key, v, label)), (key, v, label), key=lambda t: t[0])
    ints = {i: ([math.floor(256 * x) for x in v], label) for i, (_, v, label) in ok.items()}
    out = []
    for a, (q, label) in ints.items():
        if not anchor(a):
            continue
        score = {i: sum(x * y for x, y in zip(q, v)) for i, (v, _) in ints.items() if i != a and len(v) == len(q)}
        best = sorted((-s, i) for i, s in score.items() if ints[i][1] == label)[:positives]
        for sp, p in best:
            fits = sorted((-s, i) for i, s in score.items() if ints[i][1] != label and low * -sp <= 100 * s <= 100 * -sp)
            out += [(a, p, r, i, -sp, -s) for r, (s, i) in enumerate(fits[:negatives], 1)]
    return sorted(out)


SCHEMA = "vec_id long, label int, embedding array<double>, cell string, need int"


def _run(spark, rows, parts=4, **kw):
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], SCHEMA).repartition(parts)
    return sorted(tuple(r) for r in N.mine(df, F.col("vec_id") % 10 == 0, F.col("label"), **kw).collect())


@pytest.mark.parametrize("seed,kw", [(1, {}), (2, {"shard": 16, "block": 5, "step": 4}), (3, {"shard": 40, "step": 3, "positives": 2, "negatives": 7, "low": 50})])
def test_matches_brute_force(spark, seed, kw):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(5, 8))
    rows = []
    for i in range(300):
        v = centres[r.integers(5)] + r.normal(size=8) * .4 if r.random() < .7 else r.normal(size=8)
        if r.random() < .15:
            v = np.array([.5] * 8)                         # many equal vectors: ties
        rows.append((i, int(r.integers(4)), [float(x) for x in v]))
    got = _run(spark, rows, **kw)
    assert got == brute(rows, lambda a: a % 10 == 0, **{k: v for k, v in kw.items() if k in ("positives", "negatives", "low")})
    assert len(got) > 100


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 0.0]), (1, 1, [.9, .1]), (2, 2, [.85, 0.0]), (3, None, [1.0, 0.0]), (4, 1, None), (5, 2, [nan, 1.0]), (6, 2, [inf, 1.0]),
            (7, 2, [None, 1.0]), (8, 2, [1.0, 0.0, 0.0]), (None, 2, [.9, 0.0]), (1, 1, [.9, .1]), (9, 2, [.88, .0]), (9, 3, [.88, .0]),
            (10, 5, []), (11, 5, []), (12, 6, []), (20, 7, [0.0, 0.0]), (21, 7, [0.0, 0.0]), (22, 8, [.3, -.2]), (30, 9, [-1.0, 0.0]), (31, 9, [1.0, 0.0])]
    assert _run(spark, rows) == brute(rows, lambda a: a % 10 == 0)
    assert _run(spark, rows[:1]) == []
    assert N.mine(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 10 == 0, F.col("label")).collect() == []


def test_large_components(spark):
    r = random.Random(5)
    rows = [(i, i % 3, [float(r.randint(-2**20, 2**20)) for _ in range(4)]) for i in range(60)]
    assert _run(spark, rows) == brute(rows, lambda a: a % 10 == 0)


def test_members_stop_early():
    """Clustered rows: most members are certified before the end of the shared list."""
    import pandas as pd
    r = np.random.default_rng(0)
    centres = r.normal(size=(40, 16))
    v = np.floor(256 * (centres[r.integers(40, size=4000)] + .05 * r.normal(size=(4000, 16)))).astype(np.int64)
    rows = pd.DataFrame({"vec_id": np.arange(4000), "label": np.arange(4000) % 2, "v": [x.tobytes() for x in v], "dim": 16})
    asks = rows[:8].assign(cell=0, need=-np.inf)
    one = asks[[bool(((v[i] - v[0]) ** 2).sum() < 16 * 256**2 * .05) for i in range(8)]]
    seen, best = [], {}

    def wanted(members):
        scores = N.Best(len(members), 5, np.float64)
        best["b"] = scores

        def take(active, block, s):
            a, c = np.nonzero(s >= scores.score[active, -1:])
            scores.add(active[a], s[a, c], block[c])
        return (lambda: scores.score[:, -1]), take
    N._walk(rows, one, 16, wanted, 64, seen)
    assert sum(a * b for a, b in seen) < .3 * len(one) * len(rows)
    full = v[one.index.to_numpy()].astype(float) @ v.T
    assert [sorted(x)[::-1] for x in best["b"].score.tolist()] == [sorted(x)[::-1][:5] for x in full.tolist()]
