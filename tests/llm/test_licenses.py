import math
import random
import re

from conftest import SF_SMALL, SF_MID
from surveil.llm import licenses as L


def toks(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def found(text, templates):
    """Brute force: templates of which 0.8 of the shingles stand in one stretch of twice its length."""
    w, out = toks(text), set()
    for name, t in templates.items():
        tw = toks(t)
        n = min(5, len(tw))
        want = {tuple(tw[i:i + n]) for i in range(len(tw) - n + 1)}
        s = len(tw) - n + 1
        sh = [tuple(w[i:i + n]) for i in range(len(w) - n + 1)]
        if any(len(want & set(sh[a:a + s])) >= math.ceil(.8 * len(want) - 1e-9) for a in range(max(1, len(sh)))):
            out.add(name)
    return out


def test_matches_brute_force(spark):
    r = random.Random(3)
    rows = []
    for i in range(250):
        words = [r.choice("the of under license public terms any person".split()) for _ in range(r.randint(0, 120))]
        for _ in range(r.randint(0, 2)):
            t = L.TEMPLATES[r.choice(list(L.TEMPLATES))].split()
            if r.random() < .4 and len(t) > 12:
                t[r.randrange(len(t))] = "changed"
            k = r.randint(0, len(words))
            words[k:k] = t
        rows.append((i, " ".join(words).upper() if i % 9 == 0 else "\n".join(words), "x"))
    df = spark.createDataFrame(rows, "doc_id long, text string, h string")
    got = {x.doc_id: set(filter(None, x.licenses.split(","))) for x in L.scan(df).collect()}
    want = {d: found(t, L.TEMPLATES) for d, t, _ in rows}
    assert sum(map(len, want.values())) > 100
    # a stretch at the exact edge may lie in a widened window only: never less than brute force
    assert all(want[d] <= got[d] for d in want)
    wide = {d: {k for k in got[d] - want[d]} for d in want}
    assert sum(map(len, wide.values())) <= 0.05 * sum(map(len, want.values()))


def test_edges(spark):
    notice = "Released under the MIT License."
    rows = [(1, None, "x"), (2, "", "x"), (3, notice, "x"), (3, notice, "x"), (None, "a " + notice, "x"), (3, "none", "x"),
            (4, "x " * 50000 + notice + " y" * 50000, "x"), (5, "all RIGHTS, reserved", "x"), (6, notice * 3, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, h string")
    got = sorted(((r.doc_id, r.n_words, r.licenses, r.matches) for r in L.scan(df).collect()), key=lambda x: (x[0] is None, x))
    m = "mit-notice"
    assert got == [(1, 0, "", ""), (2, 0, "", ""), (3, 1, "", ""), (3, 5, m, f"{m}:0:1/1"), (3, 5, m, f"{m}:0:1/1"),
                   (4, 100005, m, f"{m}:50000:1/1"), (5, 3, "all-rights-reserved", "all-rights-reserved:0:1/1"),
                   (6, 15, m, f"{m}:0:1/1"), (None, 6, m, f"{m}:1:1/1")]
    assert L.scan(df.limit(0)).collect() == []
    assert all(r.n_licenses == 0 for r in L.scan(df, L.template_table(spark, {})).collect())


def test_lines_of_the_documents(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    got = {r.doc_id: r.licenses for r in L.scan(docs).collect()}
    for r in docs.collect():
        for name in ("mit-notice", "apache-2.0-notice", "gpl-3.0-notice", "cc-by-nc-4.0-notice", "all-rights-reserved"):
            assert (L.TEMPLATES[name] in r.text) <= (name in got[r.doc_id].split(","))


def test_no_python_in_the_scan(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    plan = L.scan(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_whole_texts_and_wordings(spark):
    """Any part of a license text is found, with changed words too, and so are other wordings of notices."""
    rows, want = [], {}
    for i, (name, text) in enumerate(sorted(L._sections().items())):
        if i % 9 == 0 or name.startswith(("mit", "bsd")):
            w = text.split()
            w[20] = w[40] = "changed"
            rows.append((i, "some words before " + " ".join(w) + " and after"))
            want[i] = name
    for i, (name, text) in enumerate(L.VARIANTS.items()):
        rows.append((10_000 + i, f"Some words before. {text} and after"))
        want[10_000 + i] = name
    got = {r.doc_id: r.licenses.split(",") for r in L.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {d: n for d, n in want.items() if n not in got[d]} == {}
    prefixes = ("mit", "apache", "gpl-2.0", "gpl-3.0", "lgpl", "agpl", "mpl", "isc", "cc0", "cc-by-sa", "unlicense", "spdx", "copyright", "bsd")
    assert all(any(n.startswith(p) for n in want.values()) for p in prefixes)
    assert len(L.shipped()) < L.MAX_TEMPLATES
