import html
import re

import numpy as np
import pytest

from conftest import SF_SMALL
from surveil.llm import html_blocks as H
from surveil.llm import html_text as T


@pytest.fixture(scope="module")
def model():
    return T.fitted()


def texts(page):
    return H.blocks(page)[0]


def article(page):
    """Main text of the given tables' pages, read with patterns: all that stands in <article>."""
    inside = page[page.index("<article>"):page.index("</article>")]
    parts = [" ".join(html.unescape(re.sub("<br>", " ", re.sub("</?b>", "", x))).split()) for x in re.split("</?(?:p|h1|article)>", inside)]
    return "\n".join(x for x in parts if x)


def test_blocks():
    page = """<!DOCTYPE html><html><head><title>No</title><style>p{a:"</p>"}</style><script>if (a<b) "</p>"</script></head>
    <body class=x>lead<p title="a>b">One &amp; <b>two</b>\n three<br>four<p>five<!-- <p>no --><ul><li>six<li>seven <a href='x>y'>eight</a></ul>
    <p>a &lt;p&gt; 1 < 2 &nbsp;&eacute;</i></div></p>tail<table><tr><td>c1<td>c2<tr><td>c3</table><svg><text>no</text></svg><textarea>no</textarea>x</body>"""
    assert texts(page) == ["lead", "One & two three four", "five", "six", "seven eight", "a <p> 1 < 2 é", "tail", "c1", "c2", "c3", "x"]
    assert texts(None) == texts("") == texts("<p> <br> </p><!-- open") == texts("<script>never closed <p>x") == []
    assert texts("plain") == ["plain"] and texts("a<p b='unclosed>c</p>") == ["a", "c"] and texts("a<p") == ["a"]


def test_paths_tell_places():
    a, b, c = (H.blocks(x)[1][0] for x in ("<nav><p>x</p></nav>", "<article><p>x</p></article>", "<div class='site-nav'><p>x</p></div>"))
    assert not np.array_equal(a, b) and not np.array_equal(b, c)
    nested = H.blocks("<nav><ul><li>a</li></ul></nav><p>b</p>")
    assert np.array_equal(nested[1][1][:H.PATH], H.blocks("<p>b</p>")[1][0][:H.PATH])       # nav is closed


def test_gradient():
    """Back-propagation equals the difference quotient."""
    r = np.random.default_rng(0)
    m = T.Labeller(hidden=3, seed=1)
    m.w = {k: v.astype(np.float64) for k, v in m.w.items()}
    pages = [r.normal(size=(n, H.SIZE)).astype(np.float32) for n in (4, 1, 6)]
    labels = [r.integers(0, 2, len(p)).astype(np.float32) for p in pages]

    def loss():
        s, y = np.concatenate(m.scores(pages)), np.concatenate(labels)
        return float(np.mean(np.log1p(np.exp(-np.where(y > .5, s, -s)))))
    grad = m.step(pages, labels)
    for k in m.w:
        for at in [tuple(r.integers(0, n) for n in m.w[k].shape) for _ in range(4)]:
            was = m.w[k][at]
            m.w[k][at] = was + 1e-3
            up = loss()
            m.w[k][at] = was - 1e-3
            down = loss()
            m.w[k][at] = was
            assert abs((up - down) / 2e-3 - grad[k][at]) < 2e-4


def test_held_out_layouts(model):
    test = T.layouts(200, seed=4711)
    right = [(s > 0) == (y > .5) for s, (_, _, y) in zip(model.scores([v for _, v, _ in test]), test)]
    assert np.mean(np.concatenate(right)) > .975
    assert np.mean([x.all() for x in right]) > .7


def test_context_matters(model):
    """The state of the other blocks reaches a block: its score is not a function of its vector alone."""
    vectors = H.blocks("<div><p>One here, two. Three.</p></div>")[1]
    more = H.blocks("<div><p>One here, two. Three.</p></div><div class=comments>x<p>nice</div>")[1]
    assert not np.allclose(model.scores([vectors])[0][0], model.scores([more])[0][0], atol=1e-3)


def test_pages_do_not_depend_on_neighbours(model):
    test = [v for _, v, _ in T.layouts(40, seed=5)]
    together = model.scores(test)
    assert max(float(np.abs(a - model.scores([p])[0]).max()) for a, p in zip(together, test)) < 1e-3


def test_whole_table(spark, model):
    df = spark.read.parquet(f"{SF_SMALL}/pages.parquet")
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in T.extract(df.repartition(3), model).collect()}
    assert got == {r.page_id: (r.url, article(r.html), len(article(r.html))) for r in df.collect()}


def test_other_layouts(spark, model):
    page = """<html><body><div class="cookie-banner"><p>We use cookies. Accept them.</p></div><header><a href=/>Site</a></header>
    <div id="content"><h1>A long walk</h1><p>It rained, and we walked. Nobody spoke.</p><p>Then the sun came out, slowly.</p></div>
    <aside class="sidebar"><ul><li><a href=/1>More</a><li><a href=/2>Other</a></ul></aside>
    <section id="comments"><h3>2 comments</h3><div class="comment"><p>Great walk, thanks for it.</p></div></section><footer>&copy; 2024 me</footer>"""
    df = spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")
    assert T.extract(df, model).first().text == "A long walk\nIt rained, and we walked. Nobody spoke.\nThen the sun came out, slowly."


def test_edges(spark, model):
    long = "<article>" + "<p>Some words, more of them.</p>" * 20_000 + "</article>"
    rows = [(1, "a", None, "t", 1), (2, None, "", "t", 2), (3, "c", "<script>x</script>", "t", 3), (None, "d", "<article><p>Yes, it is. So.</p></article>", "t", 4),
            (5, "e", long, "t", 5), (5, "e", long, "t", 5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, blocks int")
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in T.extract(df, model).collect()), key=str)
    whole = "\n".join(["Some words, more of them."] * 20_000)
    assert got == sorted([(1, "a", "", 0), (2, None, "", 0), (3, "c", "", 0), (None, "d", "Yes, it is. So.", 15), (5, "e", whole, len(whole)), (5, "e", whole, len(whole))], key=str)
    assert T.extract(df.limit(0), model).collect() == []
