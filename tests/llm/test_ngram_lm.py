import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from conftest import SF_SMALL
from surveil.llm import ngram_lm as L


def brute(rows):
    docs = []
    for d, t in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or ""))
        docs.append((d, re.findall(r"[^\x20\x09-\x0D]+", low)))
    uni, bi, ctx = Counter(), Counter(), Counter()
    each = []
    for d, w in docs:
        pairs = list(zip([None, *w], w))
        each.append((d, w, Counter(w), Counter(pairs), Counter(v for v, _ in pairs)))
        uni.update(w)
        bi.update(pairs)
        ctx.update(v for v, _ in pairs)
    total, out = sum(uni.values()), []
    for d, w, u, b, c in each:
        s, seen = 0.0, 0
        for v, x in zip([None, *w], w):
            if bi[v, x] > b[v, x]:
                s += math.log((bi[v, x] - b[v, x]) / (ctx[v] - c[v]))
                seen += 1
            else:
                s += math.log(L.ALPHA * (uni[x] - u[x] + 1) / (total - len(w) + 1))
        out.append((d, len(w), seen, s if w else None))
    return out


def check(got, want):
    key = lambda r: (r[0] is None, str(r[0]), r[1], r[2])
    got = sorted(((r.doc_id, r.n_words, r.n_seen, r.log_score) for r in got), key=key)
    want = sorted(want, key=key)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    for g, w in zip(got, want):
        assert (g[3] is None) == (w[3] is None) and (w[3] is None or g[3] == pytest.approx(w[3], abs=1e-5 * max(1, w[1])))


@pytest.mark.parametrize("per_partition", [L.PER_PARTITION, 300])
def test_matches_brute_force(spark, per_partition, monkeypatch):
    r = random.Random(per_partition)
    vocab = ["the"] * 40 + [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(r.choice(vocab) if r.random() < .9 else f"rare{r.random()}" for _ in range(r.randint(0, 80)))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "Solo"), (None, "the w1 w2"), (1, rows[1][1]), (1, rows[1][1]), (503, "The the THE"), (504, "x" * 70000)]
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, ref int").repartition(4)
    check(L.score(df, per_partition).collect(), brute(rows))
    assert L.score(df.limit(0)).collect() == []


def test_small_documents(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    check(L.score(docs, 20_000).collect(), brute([(r.doc_id, r.text) for r in docs.collect()]))


def test_blocks_round_trip():
    a = np.array([0, 1, -5, 2**62, -2**63], np.int64)
    b = a[::-1].copy()
    x, y = L.unpack(L.pack(a, b))
    assert (x == a).all() and (y == b).all() and L.unpack(L.pack(a[:0])) == []


def test_own_repeats_give_no_score(spark):
    """A document repeating words of its own scores no better per word the more it repeats."""
    r = random.Random(7)
    rows = [(i, " ".join(r.choice("a b c d e f".split()) for _ in range(50))) for i in range(40)]
    rows += [(1000 + k, " ".join(f"own{i % 9}x{k}" for i in range(k))) for k in (30, 300, 3000)]
    got = {x.doc_id: x.mean_log_score for x in L.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    total = sum(len(t.split()) for _, t in rows)
    for k in (30, 300, 3000):
        assert got[1000 + k] == pytest.approx(math.log(L.ALPHA / (total - k + 1)), abs=1e-5)


def test_bigram_of_every_document_is_not_gathered(spark, monkeypatch):
    """A stock phrase in every row, rows repeated under one id included, does not fill a partition."""
    r = random.Random(9)
    rows = [(i, "stock phrase here " + " ".join(f"w{r.randrange(50)}" for _ in range(4))) for i in range(400)]
    rows += [(7, "stock phrase")] * 100 + [(900 + i, "stock phrase") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4, "doc_id")
    seen = {}
    blocks = L._bigram_blocks

    def spy(parts, *a):
        seen.update(parts=parts, run=blocks(parts, *a))
        return seen["run"]
    monkeypatch.setattr(L, "_bigram_blocks", spy)
    check(L.score(df, 300).collect(), brute(rows))
    batch = L.pa.RecordBatch.from_arrays([L.pa.array(range(len(rows))), L.pa.array([t for _, t in rows])], ["ref", "text"])
    sizes = Counter()
    for b in seen["run"](iter([batch])):
        for p, data, n in zip(*(b.column(c).to_pylist() for c in ("part", "data", "n"))):
            if n is None:
                sizes[p] += len(L.unpack(data)[0])
    assert max(sizes.values()) <= 2 * 300
