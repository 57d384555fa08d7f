import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from surveil.llm import packing as K
from surveil.llm.queries import tokenizer_path

PATH = tokenizer_path()


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_encoder_equals_tokenizers(text):
    from tokenizers import Tokenizer
    test_encoder_equals_tokenizers.t = getattr(test_encoder_equals_tokenizers, "t", None) or Tokenizer.from_file(PATH)
    for t in (text, text + "<|endoftext|> " + text):
        assert K._encoder(PATH).encode(t) == test_encoder_equals_tokenizers.t.encode(t, add_special_tokens=False).ids


def test_level_choice_is_the_brute_force_minimum():
    """Every placement has the smallest sum of squared counts among all legal placements."""
    r = random.Random(5)
    w = 32
    p = K.Packer(w)
    for i in range(3000):
        size = r.randint(1, w - 1)
        before = p.count[1:w].copy()
        options = []
        for h in range(0, w - size + 1):
            if h and not before[h - 1]:
                continue
            c = before.copy()
            if h:
                c[h - 1] -= 1
            if h + size < w:
                c[h + size - 1] += 1
            options.append(int((c ** 2).sum()))
        list(p.add(i, np.zeros(size, "<u4")))
        assert int((p.count[1:w] ** 2).sum()) == min(options)
        assert [len(x) for x in p.open[1:]] == p.count[1:w].tolist()


def check_round_trip(rows, ids_of, window):
    """Pieces hold every id of every document once; sequences are gapless and need no padding."""
    seqs, docs = {}, {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append(r)
        docs.setdefault(r.doc_id, []).append(r)
    for pieces in seqs.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at == window or at & (at - 1) == 0 and at < window
    assert set(docs) == set(ids_of)
    for d, pieces in docs.items():
        ids, at = ids_of[d], 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at:at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)


def test_round_trip_and_edges(spark, plain):
    r = random.Random(1)
    rows = [(i, " ".join(r.choice(["alpha", "beta", "Gamma!", "é", "1,234"]) for _ in range(r.choice([1, 5, 300, 1500])))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, "x" * 300000), (203, "<|endoftext|>"), (None, "null id")]
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, offset int").repartition(5)
    got = K.pack(df, PATH).collect()
    check_round_trip(got, {d: plain.encode(t or "", add_special_tokens=False).ids + [0] for d, t in rows}, 1024)
    assert K.pack(df.limit(0), PATH).collect() == []


def test_repeated_rows_are_packed_twice(spark):
    df = spark.createDataFrame([(1, "a b c")] * 3, "doc_id long, text string")
    got = K.pack(df, PATH).collect()
    assert sum(r.length for r in got) == 3 * got[0].doc_tokens
