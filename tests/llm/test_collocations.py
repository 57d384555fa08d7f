import random
import re
from collections import Counter

import pytest

from surveil.llm import collocations as C

PIECES, WORDS = re.compile("[.,;:!?\x0A-\x0D]"), re.compile("[^\x20\x09]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, support=10, top=2000, inside=50):
    freq, total = {}, Counter()
    for lang, text in rows:
        f = freq.setdefault(lang or ("und" if lang is None else lang), Counter())
        for piece in PIECES.split((text or "").translate(LOWER)):
            w = WORDS.findall(piece)
            total["und" if lang is None else lang] += len(w)
            for k in (1, 2, 3):
                f.update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in freq.items():
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= support}
        gone = {q for p, b in cand.items() if len(p) == 3 for q in (p[:2], p[1:]) if q in cand and 100 * b >= inside * cand[q]}
        found = []
        for p, a in cand.items():
            if p in gone:
                continue
            score, k = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for i, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, i, p.decode(), -a, l, r, total[lang], -s))
    return sorted(out)


def _rows(seed, n=150):
    r = random.Random(seed)
    vocabulary = ["the", "The", "of", "Éa", "éa", "new", "york", "city", "x\x1cy", "ß", "a-b", "日本"] + [f"w{i}" for i in range(40)]
    rows = []
    for _ in range(n):
        text = ""
        for _ in range(r.randint(0, 40)):
            text += r.choice(["new york city", "of the", r.choice(vocabulary), r.choice(vocabulary)]) + r.choice([" "] * 8 + ["  ", "\t", ". ", "\n", "\x0b", ","])
        rows.append((r.choice(["en", "en", "en", "de", None, "und", ""]), text))
    return rows + [("en", None), (None, ""), ("en", " . , "), ("fr", "one"), ("es", "same words " * 30)]


def _got(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("shards,parts", [(3, 5), (1, 1), (4, 7)])
def test_matches_brute_force(spark, shards, parts):
    rows = _rows(shards)
    df = spark.createDataFrame([(*x, 7, "c") for x in rows], "lang string, text string, a int, phrase string").repartition(parts)
    assert _got(C.mine(df, shards=shards)) == brute(rows)


def test_full_filter_changes_nothing(spark, monkeypatch):
    """A filter of too few bits lets more phrases through; counts and result stay exact."""
    monkeypatch.setattr(C, "MIN_BITS", 12)
    rows = _rows(9)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    assert _got(C.mine(df, max_bits=12)) == brute(rows)


def test_top_ties_and_repeats(spark):
    rows = [("en", "aa bb. cc dd. ee ff")] * 12 + [("en", "aa bb")] * 3
    df = spark.createDataFrame(rows, "lang string, text string")
    assert _got(C.mine(df, top=2)) == brute(rows, top=2)
    assert [r[2] for r in _got(C.mine(df))] == ["aa bb", "cc dd", "ee ff"]


def test_long_text_is_whole(spark, monkeypatch):
    """Texts are cut between pieces: nothing is lost, not even in a piece longer than a chunk."""
    r = random.Random(4)
    long = " ".join(r.choice(["alpha", "beta", "gamma", "delta."]) for _ in range(60_000))
    rows = [("en", long), ("en", "one piece " * 50_000), ("de", long[:1000])]
    df = spark.createDataFrame(rows, "lang string, text string")
    want = brute(rows)
    assert _got(C.mine(df)) == want
    names = {}
    monkeypatch.setattr(C, "CHUNK", 5000)
    import pyarrow as pa
    batch = pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows]), pa.array([t for _, t in rows])], ["lang", "text"])
    cut = [(lang, t) for g in C._groups([batch], names) for lang, t in g]
    assert len(cut) > 20 and sum(len(t) for _, t in cut) == sum(len(t) for _, t in rows)
    whole = sum(len(C.Words([x]).phrases(3)) for x in cut)
    assert whole == sum(max(0, len(WORDS.findall(p)) - 2) for _, t in rows for p in PIECES.split(t))


def test_empty(spark):
    df = spark.createDataFrame([], "lang string, text string")
    assert C.mine(df).collect() == []
    assert C.mine(df).schema.names == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_scores_beyond_64_bits(spark):
    df = spark.createDataFrame([(10 ** 12, 3 * 10 ** 12 + 1, 10 ** 13 + 7)], "a long, l long, r long")
    from pyspark.sql import functions as F
    got = df.select(C._score(F.col("a"), F.col("l"), F.col("r"))).first()[0]
    assert got == 1000000 * 10 ** 24 // ((3 * 10 ** 12 + 1) * (10 ** 13 + 7))
