import hashlib
import random

import numpy as np
import pytest

from conftest import SF_SMALL
from surveil.llm import passages as P


def brute(rows, width):
    """{(doc_id, text): (bytes, removed, spans, sha)}; ids unique or repeated with equal texts."""
    seen, out = set(), {}
    for doc, text in sorted({(d, t or "") for d, t in rows if d is not None}):
        data = text.encode()
        gone = bytearray(len(data))
        for a in range(len(data) - width + 1):
            w = data[a:a + width]
            if w in seen:
                gone[a:a + width] = b"\x01" * width
            seen.add(w)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out[doc] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def _rows(seed, n=60):
    r = random.Random(seed)
    passages = ["".join(r.choice("abcde é\n") for _ in range(r.choice([40, 99, 100, 130, 300]))) for _ in range(8)]
    rows = []
    for i in r.sample(range(1000), n):
        parts = [r.choice(passages) if r.random() < .5 else "".join(r.choice("abcde é\n") for _ in range(r.randint(0, 200))) for _ in range(r.randint(0, 6))]
        rows.append((i, "".join(parts)))
    rows += [(2001, "ab" * 400), (2002, "q" * 500), (2003, rows[0][1]), (2004, rows[1][1]), (2005, "ab" * 60 + "z" + "ab" * 60)]
    for k in range(20):                               # near copies of one text
        t = list(passages[-1] * 3)
        t[r.randrange(len(t))] = "X"
        rows.append((3000 + k, "".join(t)))
    return rows


@pytest.mark.parametrize("group", [P.GROUP, 3])
def test_matches_brute_force(spark, group):
    rows = _rows(group)
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, at int").repartition(6)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in P.remove(df, group=group).collect()}
    assert got == brute(rows, 100)


def test_edges(spark):
    r = random.Random(1)
    a = "".join(r.choice("abcdefgh ") for _ in range(400))
    rows = [(1, None), (2, ""), (3, a), (3, a), (None, a), (4, a + "x"), (5, "short")]
    df = spark.createDataFrame([(*x, "k") for x in rows], "doc_id long, text string, kind string")
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in P.remove(df, with_bytes=True).collect()), key=lambda x: (x[0] is None, x))
    assert got == [(1, 0, 0, 0), (2, 0, 0, 0), (3, 400, 0, 0), (3, 400, 0, 0), (4, 401, 400, 1), (5, 5, 0, 0), (None, 400, 0, 0)]
    assert P.remove(df.limit(0)).collect() == []


def test_leftmost_minimum():
    r = np.random.default_rng(0)
    for span in (1, 2, 5, 77):
        g = r.integers(0, 6, 400).astype(np.uint64)
        want = [i + int(np.argmin(g[i:i + span])) for i in range(len(g) - span + 1)]
        assert P._leftmost_min(g, span).tolist() == want


def test_pieces_do_not_change_anchors(monkeypatch):
    r = random.Random(2)
    data = "".join(r.choice("abc ") for _ in range(5000)).encode()
    whole = P.anchors(data)
    monkeypatch.setattr(P, "PIECE", 333)
    assert all((x == y).all() for x, y in zip(whole, P.anchors(data)))
    assert (P._range_hashes(data, whole[1], whole[2] + 100) == P.Hashes(data).of(whole[1], whole[2] + 100)).all()


def test_suffix_ranks_and_previous_factors():
    r = random.Random(3)
    parts = [bytes(r.choice(b"ab") for _ in range(r.randint(1, 60))) for _ in range(40)]
    buf = np.frombuffer(b"".join(parts), np.uint8)
    size = np.array([len(p) for p in parts])
    ends = np.repeat(np.cumsum(size), size)
    raw = buf.tobytes()
    rank = P.suffix_ranks(buf, ends, 12)
    strings = [raw[i:min(i + 12, e)] for i, e in enumerate(ends)]
    order = {s: i for i, s in enumerate(sorted(set(strings)))}
    assert [order[s] + 1 for s in strings] == rank.tolist()
    gone = P.previous_factors(buf, ends, np.arange(len(buf)), 12)
    assert gone.tolist() == [len(s) == 12 and any(strings[j] == s for j in range(i)) for i, s in enumerate(strings)]


def test_small_documents_table(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in P.remove(docs).collect()}
    assert got == brute(rows, 100)
