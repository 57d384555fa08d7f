import random

import pytest

from brute_neardup import expected
from surveil.llm import neardup as N

SCHEMA = "doc_id long, text string, n_shingles string"


def _corpus(seed, groups=6, per=14):
    """Copies of a few bases with random word substitutions: similarities spread over 0.3 to 1."""
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows, i = [], 0
    for _ in range(groups):
        base = [r.choice(vocab) for _ in range(r.randint(30, 300))]
        for _ in range(per):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 25))):
                w[r.randrange(len(w))] = r.choice(vocab)
            rows.append((i, " ".join(w)))
            i += 1
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("num,block,size", [(85, 1024, 1 << 25), (80, 5, 1 << 25), (82, 1024, 4000)])
def test_components_match_brute_force(spark, num, block, size):
    rows = _corpus(num)
    want = expected(rows, num)
    df = spark.createDataFrame([(*x, "clash") for x in rows], SCHEMA)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_duplicates(df, num, 100, block=block, block_bytes=size).collect()}
    assert got == want
    assert len({c for _, c in want.values()}) < len(rows)          # the fixture does hold links


def test_edge_cases(spark):
    long = " ".join(f"x{i}" for i in range(30000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a b"), (5, "A  B"), (6, "a c"), (7, long), (8, long.upper()),
            (None, long), (9, "one two three four five"), (9, "a b"), (10, "Ä b c d e"), (11, "ä b c d e"),
            (12, "y" * 200000), (13, "Y" * 200000)]
    df = spark.createDataFrame([(*x, "clash") for x in rows], SCHEMA)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in N.near_duplicates(df).collect()),
                 key=lambda x: (x[0] is None, x))
    assert got == [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True),
                   (7, 29996, 7, True), (8, 29996, 7, False), (9, 1, 4, False), (9, 1, 4, False), (10, 1, 10, True),
                   (11, 1, 11, True), (12, 1, 12, True), (13, 1, 12, False), (None, 29996, None, True)]


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert N.near_duplicates(df).collect() == []


def test_registers_merge_and_estimate():
    import numpy as np
    r = np.random.default_rng(0)
    a = np.unique(r.integers(0, 2**63, 500).astype(np.uint64))
    b = np.unique(np.concatenate([a[:400], r.integers(0, 2**63, 100).astype(np.uint64)]))
    ra, rb, rab = N.registers([a, b, np.union1d(a, b)], 120)
    assert (np.maximum(ra, rb) == rab).all()
    keep = N.may_reach(np.stack([ra, ra]), np.stack([rb, ra]), [len(a)] * 2, [len(b), len(a)], 0.95)
    assert keep.tolist() == [False, True]


def test_early_drop_equals_the_whole_search():
    """``may_reach`` drops on one likelihood value only what a search for the peak drops."""
    import math

    import numpy as np
    r = np.random.default_rng(3)
    n, m, t = 3000, 120, 0.85
    shared = r.random(n)[:, None]
    a = r.integers(0, 5000, (n, m))
    b = np.where(r.random((n, m)) < shared, a, r.integers(0, 5000, (n, m)))
    na, nb = r.integers(50, 100, n), r.integers(50, 100, n)
    got = N.may_reach(a.astype(np.uint16), b.astype(np.uint16), na, nb, t)
    grid = np.linspace(0, 1, 4001)
    for i in range(0, n, 10):
        u = na[i] / (na[i] + nb[i])
        top = min(u / (1 - u), (1 - u) / u)
        more, less = int((a[i] > b[i]).sum()), int((a[i] < b[i]).sum())

        def ll(j):
            p = [np.clip(-np.log1p(-np.clip(x, 0, 1) * (N.BASE - 1) / N.BASE) / math.log(N.BASE), 1e-12, 1)
                 for x in (u - (1 - u) * j, 1 - u - u * j)]
            return (more * np.log(p[0]) + less * np.log(p[1])
                    + (m - more - less) * np.log(np.clip(1 - p[0] - p[1], 1e-12, 1)))
        js = grid[grid <= top]
        best = ll(js).max() - ll(np.array(min(t, top)))
        if abs(best - N.LLR) > 0.01 and abs(js[ll(js).argmax()] - t) > 0.001 and abs(top - t) > 1e-6:
            assert got[i] == (top >= t and (js[ll(js).argmax()] >= t or best <= N.LLR)), i


def test_one_bucket_of_many_unlike_texts(spark):
    """Texts that share a band but no link: only members with a plausible partner keep their sets."""
    rows = []
    for i in range(240):
        w = [f"c{k}" for k in range(60)] + [f"v{i // 2}x{k}" for k in range(14)] + ([f"w{i}"] if i % 2 else [])
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame([(*x, "clash") for x in rows], SCHEMA)
    for block in (16, 1024):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_duplicates(df, block=block).collect()}
        assert got == expected(rows, 85)
