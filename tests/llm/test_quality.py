import math
import random
import re

import numpy as np
import pytest

from surveil.llm import quality as Q
from surveil.llm.selection import kth_largest


def test_kth_largest(spark):
    r = random.Random(3)
    xs = [r.choice([r.gauss(0, 1e-9), r.gauss(0, 1e6), 5.0, -7.0]) for _ in range(5000)]
    df = spark.createDataFrame([(x,) for x in xs] + [(None,), (math.nan,), (math.inf,)], "x double")
    want = sorted(xs, reverse=True)
    for k in (1, 2, 700, 2500, 5000):
        assert kth_largest(df, "x", k) == want[k - 1]
    assert kth_largest(df, "x", 5001) is None and kth_largest(df.limit(0), "x", 1) is None


def test_kth_largest_small_bins(spark, monkeypatch):
    import surveil.llm.selection as S
    monkeypatch.setattr(S, "BINS", 4)
    monkeypatch.setattr(S, "SMALL", 3)
    xs = [i ** 3 / 7 for i in range(200)] * 2
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for k in (1, 5, 199, 400):
        assert kth_largest(df, "x", k) == sorted(xs, reverse=True)[k - 1]


def test_histogram_and_weights_match_plain_counts():
    texts = [b"", b"One two one two!! ", "été 42 A".encode(), b"x " * 3000]
    total = Q.histogram(texts)
    ratio = np.arange(len(total)) / 1e4
    w, n = Q.weights(texts, ratio)
    for i, t in enumerate(texts):
        h = Q.histogram([t])
        assert math.isclose(w[i], (h * ratio).sum()) and n[i] == h.sum()
    assert (total == sum(Q.histogram([t]) for t in texts)).all()
    # tokens: one two one two !! -> 5; surface 5+4, shapes 5+4+3
    assert n[1] == 21


def test_long_text_in_pieces_loses_nothing(monkeypatch):
    t = " ".join(f"w{i % 900} x{i % 7},," for i in range(5000)).encode()
    whole = Q.histogram([t])
    monkeypatch.setattr(Q.X, "CHUNK", 1000)
    assert (Q.histogram([t]) == whole).all() and (Q.histogram([b"a b", t, b"c"]) == whole + Q.histogram([b"a b"]) + Q.histogram([b"c"])).all()


def _plain(text):
    """Buckets of all n-grams of one text, token by token."""
    toks = re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x09-\x0d\x20]+", text)
    h = [int(Q._tokens(np.frombuffer(t, np.uint8))[1][0]) for t in toks]
    shapes, words = [], []
    for t, x in zip(toks, h):
        if not re.match(rb"[0-9A-Za-z\x80-\xff]", t):
            shapes.append(64 + min(len(t), 8) + x % 32 * 16 + 1)
            continue
        up, low, dig = (len(re.findall(p, t)) for p in (rb"[A-Z]", rb"[a-z]", rb"[0-9]"))
        case = 3 if dig else 2 if up >= 2 and not low else 1 if up else 0
        shapes.append(case * 8 + min(len(t) // 4, 3) + 4 * (x in words[-3:]) + 1)
        words.append(x)
    out = []
    for values, orders, base, size in ((h, (1, 2), 0, Q.SURFACE), (shapes, (1, 2, 3), Q.SURFACE, Q.SHAPE)):
        for n in orders:
            for i in range(len(values) - n + 1):
                out.append(base + int(Q.X.gram_hashes(np.array(values[i:i + n], np.uint64), n)[0]) % size)
    return out


def _brute(rows, lab, noise, k=None, sharpness=Q.SHARPNESS):
    """{doc_id: (score, kept)} of the whole query; noise: {doc_id: hash}."""
    grams = {d: _plain((t or "").encode()) for d, t in rows}
    good = {d: min(q for e, q in lab if e == d) == 1 for d, _ in lab if d in grams}
    raw, target = np.zeros(Q.SURFACE + Q.SHAPE), np.zeros(Q.SURFACE + Q.SHAPE)
    for d, g in grams.items():
        for b in g:
            raw[b] += 1
            target[b] += good.get(d, False)
    ratio = np.zeros(len(raw))
    for part in (slice(0, Q.SURFACE), slice(Q.SURFACE, None)):
        t, r = target[part] + Q.SMOOTH, raw[part] + Q.SMOOTH
        ratio[part] = np.log(t / t.sum()) - np.log(r / r.sum())
    ratio = ratio.astype(np.float32)
    score = {d: float(np.sum(ratio[g].astype(float))) / len(g) for d, g in grams.items() if g}
    known = sorted((score[d], y) for d, y in good.items() if d in score)
    best = max(range(len(known) + 1), key=lambda i: (sum(y for _, y in known[i:]) / sum(y for _, y in known) + sum(not y for _, y in known[:i]) / sum(not y for _, y in known), -i))
    cut = -math.inf if best == 0 else (known[best - 1][0] + known[min(best, len(known) - 1)][0]) / 2
    key = {d: sharpness * s - math.log(-math.log((((noise[d] % 2**64) >> 11) + .5) / 2.0**53)) for d, s in score.items()}
    k = sum(s >= cut for s in score.values()) if k is None else k
    last = sorted(key.values(), reverse=True)[min(k, len(key)) - 1]
    return {d: (score.get(d), d in key and key[d] >= last) for d in grams}


@pytest.mark.parametrize("k,sharpness", [(None, Q.SHARPNESS), (60, 1.0)])
def test_whole_query_matches_brute_force(spark, k, sharpness):
    from pyspark.sql import functions as F
    rows, lab = _corpus(160)
    rows = [(d, t) for d, t, _ in rows] + [(900, None), (901, "  ")]
    lab = [(d, q) for d, q, _ in lab] + [(1, 1), (900, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(lab, "doc_id long, quality int")
    noise = {r[0]: r[1] for r in docs.select("doc_id", F.xxhash64("doc_id", F.lit(0))).collect()}
    want = _brute(rows, lab, noise, k, sharpness)
    for parts in (1, 7):
        got = {r.doc_id: (r.score, r.kept) for r in Q.resample(docs.repartition(parts), labels, k=k, sharpness=sharpness).collect()}
        assert {d: kept for d, (_, kept) in got.items()} == {d: kept for d, (_, kept) in want.items()}
        assert all((a is None) == (want[d][0] is None) and (a is None or math.isclose(a, want[d][0], rel_tol=1e-6, abs_tol=1e-6)) for d, (a, _) in got.items())


def test_draw_decides(spark):
    """Seed and sharpness change the sample; better documents are drawn more often."""
    rows, lab = _corpus(300)
    docs = spark.createDataFrame(rows, "doc_id long, text string, x string")
    labels = spark.createDataFrame(lab, "doc_id long, quality int, text string")
    a, b, c = ({r.doc_id for r in Q.resample(docs, labels, seed=s, k=150, sharpness=t).collect() if r.kept} for s, t in ((0, 1.0), (1, 1.0), (0, 1000.0)))
    assert len(a) == len(b) == len(c) == 150 and a != b and a != c
    assert len(a & c) > 75


def test_scores_do_not_depend_on_the_batch():
    texts = [b"one two three", b"three one one", b"one", b"Two three!! three"]
    ratio = np.random.default_rng(0).normal(size=Q.SURFACE + Q.SHAPE)
    together, _ = Q.weights(texts, ratio)
    assert np.allclose(together, [Q.weights([t], ratio)[0][0] for t in texts])


def _corpus(n, seed=0):
    r = random.Random(seed)
    rows, lab = [], []
    for i in range(n):
        words = [r.choice(["the", "of", "and", "to"]) if r.random() < .4 else "".join(r.choice("aeinorst") for _ in range(r.randint(2, 9)))
                 for _ in range(r.randint(40, 200))]
        bad = i % 7 == 0
        t = " ".join(w.upper() + "!!" for w in words) if bad and i % 2 else " ".join(w + "###" for w in words) if bad else " ".join(words) + "."
        rows.append((i, t, "x"))
        if i % 3:
            lab.append((i, 0 if bad else 1, "y"))
    return rows, lab


def test_held_out_accuracy_and_edges(spark):
    rows, lab = _corpus(400)
    extra = [(1000, None, "x"), (1001, "", "x"), (None, rows[1][1], "x"), (1, rows[1][1], "x")]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string, quality string")
    labels = spark.createDataFrame(lab, "doc_id long, quality int, text string")
    got = Q.resample(docs, labels).collect()
    assert len(got) == 404
    held = [r for r in got if r.doc_id is not None and r.doc_id < 400 and r.doc_id % 3 == 0]
    right = sum(r.kept == bool(r.doc_id % 7) for r in held) / len(held)
    assert right >= 0.98
    by = {r.doc_id: r.kept for r in got}
    assert not by[1000] and not by[1001] and by[None]
    kept = {(r.doc_id, r.text) for r in Q.keep(docs, labels).collect()}
    assert Q.keep(docs, labels).columns == docs.columns
    assert {d for d, _ in kept} == {r.doc_id for r in got if r.kept}


def test_without_labels_everything_with_text_is_kept(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.doc_id: r.kept for r in Q.resample(docs, labels).collect()} == {1: True, 2: False}
    assert Q.resample(docs.limit(0), labels).collect() == []
