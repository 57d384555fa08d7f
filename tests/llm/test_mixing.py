import random

import pytest
from pyspark.sql import functions as F

from surveil.llm import mixing as M


def fill(budget, kids):
    """Brute-force share: {name: (cap, weight)} -> {name: amount}."""
    out = {k: 0.0 for k in kids}
    live = {k for k, (c, w) in kids.items() if w > 0}
    left = budget
    while live:
        total = sum(kids[k][1] for k in live)
        full = {k for k in live if kids[k][0] <= left * kids[k][1] / total + 1e-9}
        if not full:
            for k in live:
                out[k] = left * kids[k][1] / total
            break
        for k in full:
            out[k] = kids[k][0]
        left -= sum(kids[k][0] for k in full)
        live -= full
    return out


def _docs(spark, n=600, seed=0):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        lang = r.choice(["en"] * 6 + ["de", "fr", None])
        rows.append((i, " ".join("w" * r.randint(1, 5) for _ in range(r.randint(0, 40))), lang,
                     "src0" if r.random() < .4 else f"src{r.randint(0, 14)}", "clash", 7))
    rows += [(9001, None, "en", "src1", "x", 1), (9002, "a b", "en", None, "x", 1), (None, "a b", "es", "src2", "x", 1),
             (5, "dup dup", "en", "src3", "x", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, domain string, epochs int"), rows


def test_share_matches_brute_force(spark):
    r = random.Random(2)
    rows, want = [], {}
    for p in range(30):
        kids = {f"k{i}": (float(r.randint(0, 100)), r.choice([0.0, 1.0, 2.0, 5.0])) for i in range(r.randint(1, 8))}
        budget = float(r.randint(0, 300))
        for k, v in fill(budget, kids).items():
            want[(p, k)] = v
        rows += [(p, k, c, w, budget) for k, (c, w) in kids.items()]
    df = spark.createDataFrame(rows, "p int, kid string, cap double, weight double, budget double")
    got = {(x.p, x.kid): x.budget for x in M.share(df, ["p"], "kid").collect()}
    assert got == pytest.approx(want)


@pytest.mark.parametrize("fraction,epochs", [(0.6, 1), (1.3, 2), (5.0, 2), (0.0, 1)])
def test_budgets_and_prefixes(spark, fraction, epochs):
    df, rows = _docs(spark)
    weights = M.Weights()
    got = M.mix(df, fraction=fraction, epochs=epochs).collect()
    total = sum(len((t or "").split()) for _, t, *_ in rows)
    # brute force budgets down the tree
    leaf = {}
    for d, t, l, s, *_ in rows:
        s = s or M.NONE
        dom = "curated" if s[3:].isdigit() and int(s[3:]) >= 10 else "web"
        leaf.setdefault((dom, l or M.NONE, s), []).append((d, len((t or "").split())))
    cap = {k: float(epochs * sum(n for _, n in v)) for k, v in leaf.items()}

    def node(prefix):
        return sum(v for k, v in cap.items() if k[:len(prefix)] == prefix)

    def down(prefix, amount):
        if len(prefix) == 3:
            yield prefix, amount
            return
        level = M.LEVELS[len(prefix)]
        kids = {k[len(prefix)] for k in cap if k[:len(prefix)] == prefix}
        table = getattr(weights, level)
        shares = fill(amount, {k: (node((*prefix, k)), table.get(k, 1.0)) for k in kids})
        for k, v in shares.items():
            yield from down((*prefix, k), v)
    want = dict(down((), total * fraction))
    taken = {}
    for r in got:
        taken.setdefault((r.domain, r.lang, r.source), []).append(r)
    for k, b in want.items():
        tokens = sum(r.tokens for r in taken.get(k, []))
        longest = max(n for _, n in leaf[k])
        assert tokens <= b + 1e-3 and (tokens >= min(b, cap[k]) - 2 * longest - 1)
        per_epoch = {}
        for r in taken.get(k, []):
            per_epoch.setdefault(r.epoch, []).append(r.doc_id)
        for e in range(max(per_epoch, default=0)):
            assert len(per_epoch[e]) == len(leaf[k])            # all epochs before the last are whole
    assert M.mix(df, fraction=fraction, epochs=epochs, seed=0).exceptAll(
        spark.createDataFrame(got, schema="doc_id long, domain string, lang string, source string, tokens long, epoch long")).count() == 0


def test_prefix_is_the_hash_order(spark):
    df = spark.createDataFrame([(i, "a " * 10, "en", "src1") for i in range(300)], "doc_id long, text string, lang string, source string")
    got = {r.doc_id for r in M.mix(df, budget=1000, epochs=1).collect()}
    order = df.orderBy(F.xxhash64("doc_id", F.lit(0).cast("long") + F.lit(0))).limit(100)
    assert got == {r.doc_id for r in order.collect()}


def test_rows_keep_columns(spark):
    df, _ = _docs(spark)
    out = M.mix_rows(df, fraction=0.5)
    assert out.columns == df.columns
    a = sorted(str(r.doc_id) for r in out.collect())
    assert a == sorted(str(r.doc_id) for r in M.mix(df, fraction=0.5, epochs=1).collect())
    assert M.mix(df.limit(0)).collect() == []
