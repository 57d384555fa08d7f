import random

import corpus_pipeline as C
import __spark_entry__ as E
from brute_neardup import expected
from conftest import SF_SMALL
from surveil.llm import pii


def test_stages_and_registration(spark):
    assert [n for n, _ in C.STAGES] == ["quality", "near_duplicates", "pii", "mixing", "packing"]
    q = E.queries()
    assert "pipeline" in q and len([n for n in q if n.startswith("op")]) == len(
        [n for n in E._llm.queries() if n.startswith("op")])


def test_pipeline_on_small_tables(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    after = {}
    cur = docs
    for name, stage in C.STAGES:
        cur = C.stored(stage(spark, cur, SF_SMALL), name)
        after[name] = cur
        if name != "packing":
            assert cur.columns == docs.columns
    ids = {n: {r.doc_id for r in d.select("doc_id").collect()} for n, d in after.items()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_SMALL}/labels.parquet").collect()}
    assert {d for d, q in labels.items() if q == 1} <= ids["quality"]
    assert not {d for d, q in labels.items() if q == 0} & ids["quality"]
    texts = [(r.doc_id, r.text) for r in after["quality"].collect()]
    want = expected(texts, 80)
    assert ids["near_duplicates"] == {d for d, (_, c) in want.items() if c == d}
    assert ids["pii"] == ids["near_duplicates"]
    for r in after["pii"].collect():
        assert pii.base_spans(r.text) == [] and r.n_chars == len(r.text)
    assert ids["mixing"] <= ids["pii"] and len(ids["mixing"]) > 0.6 * len(ids["pii"])
    assert ids["packing"] == ids["mixing"]


def test_stages_on_edge_rows(spark):
    r = random.Random(0)
    rows = [(i, " ".join(r.choice(["alpha", "beta", "gamma"]) for _ in range(30)), "en", "src1", 5, "z") for i in range(8)]
    rows += [(8, None, None, None, None, None), (None, "a b", "en", None, 3, "z"), (9, "", "de", "src2", 0, "z"), (1, rows[1][1], "en", "src1", 5, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, tokens string")
    for docs in (df, df.limit(0)):
        cur = docs
        for name, stage in C.STAGES:
            cur = C.stored(stage(spark, cur, SF_SMALL), name)
            if name != "packing":
                assert cur.columns == df.columns
        if docs is not df:
            assert cur.count() == 0
