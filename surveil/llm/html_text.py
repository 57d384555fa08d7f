"""Main text of HTML pages: a bidirectional LSTM (numpy) labels every leaf block in its document's context.

A page is read as the sequence of its blocks (``html_blocks``); each block's vector holds its hashed tag path
(element names, class and id words of all ancestors), the same for its own and its parent's element, its hashed
words, and a few lengths and shares. One LSTM reads the sequence forwards and one backwards; both states and the
vector itself give the block's score, and blocks with a positive score are the main text.

The labels to learn from are pages that ``layouts`` writes by rule (a documented number, ``PAGES``): articles of
pseudo-words in many templates, with menus, headers, footers, sidebars, notices, adverts, forms and comments
around and between them. The fit runs once on the driver and does not depend on the table; its weights (some
170 KB) go to the tasks, which handle each page on its own.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveil.llm import html_blocks as H

PAGES, EPOCHS, HIDDEN, SEED = 900, 20, 24, 12
TOGETHER = 4096          # blocks scored together


# ---------------------------------------------------------------- training pages

# fixed values: words by which templates name the parts of a page
MAIN = "content main article post entry story text body article-body post-content entry-content page-content main-content articleBody mw-content prose".split()
PARTS = {
    "nav": "nav menu navbar navigation main-menu breadcrumb breadcrumbs topnav tabs pagination pager toc-nav links".split(),
    "header": "header masthead site-header top topbar branding logo banner-top".split(),
    "footer": "footer site-footer bottom copyright colophon foot legal imprint".split(),
    "sidebar": "sidebar side widget widgets rail right-column left-column related related-posts popular recommended more-stories aside teaser".split(),
    "notice": "cookie cookies notice alert consent gdpr banner privacy-notice message paywall disclaimer popup modal overlay".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion adsbox commercial".split(),
    "form": "form search login subscribe newsletter signup contact search-box".split(),
    "share": "share social sharing follow byline-share tags meta-tools toolbar".split(),
    "comments": "comments comment comment-list discussion replies reply responses disqus reader-comments comment-body user-comments".split(),
}
SAYS = {
    "nav": "home about contact news sport archive next previous page login more back top".split(),
    "header": "welcome search menu the daily site news subscribe sign in".split(),
    "footer": "© copyright all rights reserved privacy policy terms imprint contact · 2024 inc".split(),
    "sidebar": "related popular most read recent posts read more see also categories tags archive".split(),
    "notice": "we use cookies accept this site notice please agree your privacy consent settings close".split(),
    "ad": "advertisement sponsored buy now sale offer discount free shipping click here".split(),
    "form": "search name email password submit send your message subscribe newsletter sign up".split(),
    "share": "share tweet like print email facebook follow us tags posted in".split(),
    "comments": "reply says comment posted by ago great thanks likes report permalink".split(),
}
HTML5 = {"nav": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "notice": "aside", "form": "form"}
SYLLABLES = "the and ing ion er es ed re in on la de que ou an der sch ung ein ver cht ar os ción do el ñas én è à ß ö 日 本 語 да но ст".split()


class _Writer:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choices(SYLLABLES, k=self.r.randint(1, 4)))

    def prose(self, low: int, high: int) -> str:
        r, out = self.r, []
        for _ in range(r.randint(low, high)):
            s = " ".join(self.word() for _ in range(r.randint(1, 16))).capitalize()
            out.append(s.replace(" ", ", ", 1) + r.choice("...!?") if r.random() < .5 else s + ".")
        return " ".join(out)

    def junk(self) -> str:
        return " ".join(self.word() + self.r.choice(["", "###", "%%%", "&amp;&amp;", "***", "$$$"]) for _ in range(self.r.randint(1, 40)))

    def phrase(self, kind: str) -> str:
        r = self.r
        return " ".join(r.choice(SAYS[kind]) if r.random() < .5 else self.word() for _ in range(r.randint(1, 6)))

    def named(self, names: list[str]) -> str:
        r = self.r
        name = r.choice(names)
        if r.random() < .25:
            name = f"{self.word()}-{name}" if r.random() < .5 else f"{name}_{r.randint(1, 99)}"
        return f' {r.choice(["class", "class", "id"])}="{name}{" " + self.word() if r.random() < .3 else ""}"'

    def inline(self, text: str) -> str:
        r, words = self.r, text.split(" ")
        for _ in range(r.choice([0, 0, 1, 2])):
            i = r.randrange(len(words))
            tag = r.choice(["b", "i", "em", "strong", "span", "code", 'a href="/x"'])
            words[i] = f"<{tag}>{words[i]}</{tag.split()[0]}>"
        if r.random() < .1:
            words.insert(r.randrange(len(words)), "<br>")
        return " ".join(words)

    def good(self) -> str:
        """One or more blocks of an article; \x01 marks their texts."""
        r, k = self.r, self.r.random()
        m = lambda low, high: "\x01" + (self.junk() if r.random() < .07 else self.inline(self.prose(low, high)))
        if k < .64:
            return f"<p>{m(1, 7)}" + r.choice(["</p>", "</p>", "</p>", ""])
        if k < .7:
            return f"<p><b>{m(1, 1)}<br><p>{m(1, 3)}</p>"
        if k < .78:
            h = r.choice(["h2", "h3", "h4"])
            return f"<{h}>\x01{self.prose(1, 1)[:40]}</{h}>"
        if k < .85:
            u = r.choice(["ul", "ol"])
            return f"<{u}>" + "".join(f"<li>{m(1, 1)}" + r.choice(["</li>", ""]) for _ in range(r.randint(2, 5))) + f"</{u}>"
        if k < .9:
            return f"<blockquote>{r.choice(['', '<p>'])}{m(1, 3)}</blockquote>"
        if k < .93:
            return f"<pre>\x01{self.prose(1, 2)}</pre>"
        if k < .96:
            return f"<figure><img src=x><figcaption>{m(1, 1)}</figcaption></figure>"
        return "<table>" + "".join("<tr>" + "".join(f"<td>\x01{self.word()}</td>" for _ in range(3)) + "</tr>" for _ in range(2)) + "</table>"

    def bad(self, kind: str) -> str:
        r = self.r
        tag = HTML5[kind] if kind in HTML5 and r.random() < .6 else r.choice(["div", "div", "div", "section", "ul"] if kind != "comments" else ["div", "section", "ol"])
        attr = self.named(PARTS[kind]) if r.random() < (.35 if tag in HTML5.values() else 1) else ""
        if kind in ("nav", "share") or kind in ("sidebar", "footer", "header") and r.random() < .4:
            items = [f'<a href="/{self.word()}">{self.phrase(kind) if r.random() < .5 else self.word()}</a>' for _ in range(r.randint(1, 8))]
            body = "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if r.random() < .7 else r.choice([" ", " | ", "<br>"]).join(items)
        elif kind == "form":
            body = f"<label>{self.phrase(kind)}</label><input name=q><button>{self.phrase(kind)}</button>" + (f"<select><option>{self.word()}<option>{self.word()}</select>" if r.random() < .3 else "")
            body += f"<p>{self.prose(1, 1)}</p>" if r.random() < .3 else ""
        elif kind == "comments":
            inner = lambda: f"<p>{self.prose(1, 4)}</p>" if r.random() < .7 else self.prose(1, 3)
            body = (f"<h3>{self.phrase(kind)}</h3>" if r.random() < .5 else "") + "".join(
                f"<{r.choice(['div', 'li', 'article'])}{self.named(PARTS[kind]) if r.random() < .6 else ''}>" + (f"<b>{self.word()}</b> " if r.random() < .5 else "") + inner() + "</div>" for _ in range(r.randint(1, 4)))
        else:
            text = self.phrase(kind) if r.random() < .35 else self.prose(1, 3)
            text = f"&copy; {self.word()}.example.com &middot; {text}" if kind == "footer" and r.random() < .5 else text
            body = r.choice([text, text, f"<p>{text}</p>", f"<h3>{self.phrase(kind)}</h3><p>{text}</p>"])
        return f"<{tag}{attr}>{body}</{tag}>"

    def page(self) -> str:
        r = self.r
        title = self.prose(1, 1)[:60] if r.random() < .9 else self.junk()
        before = [self.bad(k) for k in ("notice", "header", "nav", "ad", "form", "sidebar", "share") if r.random() < .45]
        after = [self.bad(k) for k in ("share", "sidebar", "comments", "form", "ad", "notice", "nav", "footer") if r.random() < .45]
        r.shuffle(before)
        r.shuffle(after)
        main = [self.good() for _ in range(r.choice([0, 1, 1, 2, 2, 4, 8, 14, 20]))]
        if r.random() < .3:                                        # the first line again under the heading
            main.insert(0, r.choice([f"<p><b>\x01{title}<br>", f"<p>\x01{title}</p>"]))
        if r.random() < .3 and len(main) > 2:                      # an advert or a form inside the article
            main.insert(r.randrange(1, len(main)), self.bad(r.choice(["ad", "share", "sidebar", "notice", "form"])))
        head = f"<h1>\x01{title}</h1>" if r.random() < .85 else ""
        body = "".join(([head] if head else []) + main)
        k = r.random()
        if k < .5:
            body = f"<article{self.named(MAIN) if r.random() < .3 else ''}>{body}</article>"
        elif k < .65:
            body = f"<main{self.named(MAIN) if r.random() < .3 else ''}>{body}</main>"
        elif k < .93:
            body = f"<div{self.named(MAIN)}>{body}</div>"
        if r.random() < .4:
            body = f"<div{self.named(MAIN + ['wrapper', 'container', 'page', 'row'])}>{body}</div>"
        inside = after.pop() if after and r.random() < .3 and k < .5 else ""
        if inside and body.endswith("</article>"):                  # comments and the like may stand inside the article element
            body = body[:-len("</article>")] + inside + "</article>"
        return f"<!DOCTYPE html><html><head><title>{title}</title></head><body>{''.join(before)}{body}{''.join(after)}" + r.choice(["</body></html>", ""])


def layouts(n: int, seed: int) -> list[tuple[list[str], np.ndarray, np.ndarray]]:
    """(texts, vectors, labels) of ``n`` pages written by rule."""
    out = []
    for i in range(n):
        texts, vectors = H.blocks(_Writer(seed * 1_000_003 + i).page())
        if not texts:
            continue
        label = np.array(["\x01" in t for t in texts], np.float32)
        out.append(([t.replace("\x01", "") for t in texts], vectors, label))
    return out


# ---------------------------------------------------------------- the model

def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _pad(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(map(len, pages))
    x = np.zeros((len(pages), longest, pages[0].shape[1]), np.float32)
    mask = np.zeros((len(pages), longest, 1), np.float32)
    for i, p in enumerate(pages):
        x[i, :len(p)], mask[i, :len(p)] = p, 1
    return x, mask


class Labeller:
    """Two LSTMs and a linear layer over their states and the block's vector."""

    def __init__(self, hidden: int = HIDDEN, seed: int = SEED):
        r = np.random.Generator(np.random.PCG64(seed))
        self.h = hidden
        self.w = {}
        for d in "fb":
            self.w["W" + d] = r.normal(0, SIZE_SCALE, (H.SIZE, 4 * hidden)).astype(np.float32)
            self.w["U" + d] = r.normal(0, hidden ** -.5, (hidden, 4 * hidden)).astype(np.float32)
            self.w["c" + d] = np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)]).astype(np.float32)
        self.w["V"] = r.normal(0, .1, (2 * hidden + H.SIZE, 1)).astype(np.float32)
        self.w["v"] = np.zeros(1, np.float32)

    def _read(self, d: str, x: np.ndarray, mask: np.ndarray, tape: list | None = None) -> np.ndarray:
        n, length, _ = x.shape
        z0 = x @ self.w["W" + d] + self.w["c" + d]
        h = c = np.zeros((n, self.h), np.float32)
        out = np.zeros((n, length, self.h), np.float32)
        for t in range(length) if d == "f" else range(length - 1, -1, -1):
            z = z0[:, t] + h @ self.w["U" + d]
            i, f, o = (_sigmoid(z[:, k * self.h:(k + 1) * self.h]) for k in (0, 1, 2))
            g = np.tanh(z[:, 3 * self.h:])
            m, before, was = mask[:, t], c, h
            new = f * c + i * g
            squashed = np.tanh(new)
            c, h = m * new + (1 - m) * c, m * (o * squashed) + (1 - m) * h
            out[:, t] = h
            if tape is not None:
                tape.append((t, i, f, o, g, m, before, was, squashed))
        return out

    def _back(self, d: str, x: np.ndarray, tape: list, dout: np.ndarray, grad: dict) -> None:
        dz0 = np.zeros((*x.shape[:2], 4 * self.h), np.float32)
        dh = dc = np.zeros((x.shape[0], self.h), np.float32)
        for t, i, f, o, g, m, before, was, squashed in reversed(tape):
            dh = dh + dout[:, t]
            here = m * dh
            dnew = m * dc + here * o * (1 - squashed ** 2)
            dz = np.concatenate([dnew * g * i * (1 - i), dnew * before * f * (1 - f), here * squashed * o * (1 - o), dnew * i * (1 - g ** 2)], axis=1)
            dz0[:, t] = dz
            grad["U" + d] += was.T @ dz
            dh = (1 - m) * dh + dz @ self.w["U" + d].T
            dc = (1 - m) * dc + dnew * f
        grad["W" + d] += np.tensordot(x, dz0, ([0, 1], [0, 1]))
        grad["c" + d] += dz0.sum((0, 1))

    def scores(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Score of each block of each page; above 0: main text."""
        x, mask = _pad(pages)
        both = np.concatenate([self._read("f", x, mask), self._read("b", x, mask), x], axis=2)
        s = (both @ self.w["V"] + self.w["v"])[..., 0]
        return [s[i, :len(p)] for i, p in enumerate(pages)]

    def step(self, pages: list[np.ndarray], labels: list[np.ndarray]) -> dict:
        """Gradient of the mean log loss over the blocks."""
        x, mask = _pad(pages)
        y, _ = _pad([np.asarray(t, np.float32)[:, None] for t in labels])
        tapes = {"f": [], "b": []}
        both = np.concatenate([self._read("f", x, mask, tapes["f"]), self._read("b", x, mask, tapes["b"]), x], axis=2)
        ds = mask * (_sigmoid(both @ self.w["V"] + self.w["v"]) - y) / mask.sum()
        grad = {k: np.zeros_like(v) for k, v in self.w.items()}
        grad["V"] += np.tensordot(both, ds, ([0, 1], [0, 1]))
        grad["v"] += ds.sum((0, 1))
        dboth = ds @ self.w["V"].T
        self._back("f", x, tapes["f"], dboth[..., :self.h], grad)
        self._back("b", x, tapes["b"], dboth[..., self.h:2 * self.h], grad)
        return grad


SIZE_SCALE = .5 * H.SIZE ** -.5


@lru_cache(maxsize=4)
def fitted(pages: int = PAGES, epochs: int = EPOCHS, hidden: int = HIDDEN, seed: int = SEED, rate: float = .012, batch: int = 64) -> Labeller:
    """A labeller fitted to ``pages`` rule-written pages by Adam; the same for the same parameters."""
    data = sorted(layouts(pages, seed), key=lambda p: len(p[1]))
    model, r = Labeller(hidden, seed), random.Random(seed)
    first, second = ({k: np.zeros_like(v) for k, v in model.w.items()} for _ in range(2))
    batches, n = [data[a:a + batch] for a in range(0, len(data), batch)], 0
    for epoch in range(epochs):
        r.shuffle(batches)
        for b in batches:
            n += 1
            grad = model.step([v for _, v, _ in b], [y for _, _, y in b])
            size = np.sqrt(sum(float((g ** 2).sum()) for g in grad.values()))
            now = rate * min(1.0, n / 20) * (1 - .9 * epoch / epochs)
            for k, g in grad.items():
                g = g / max(1.0, size)
                first[k] = .9 * first[k] + .1 * g
                second[k] = .999 * second[k] + .001 * g * g
                model.w[k] = (model.w[k] - now * (first[k] / (1 - .9 ** n)) / (np.sqrt(second[k] / (1 - .999 ** n)) + 1e-8)).astype(np.float32)
    return model


# ---------------------------------------------------------------- over a table

def _label(model: Labeller):
    """Adds the blocks' texts and scores to (page_id, url, html)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(group: list) -> pa.RecordBatch:
            # pages of like length together: little padding; a page's scores do not depend on its neighbours
            full = sorted((i for i, (_, _, texts, _) in enumerate(group) if texts), key=lambda i: len(group[i][2]))
            scores: dict[int, np.ndarray] = {}
            for a in range(0, len(full), 32):
                some = full[a:a + 32]
                scores |= dict(zip(some, model.scores([group[i][3] for i in some])))
            pages, urls, texts, _ = zip(*group)
            return pa.RecordBatch.from_arrays([pa.array(pages, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.list_(pa.string())),
                                               pa.array([scores[i] if t else [] for i, t in enumerate(texts)], pa.list_(pa.float32()))], ["page_id", "url", "blocks", "scores"])
        group, size = [], 0
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                for page, url, source in zip(*(c.slice(a, 64).to_pylist() for c in batch.columns)):
                    group.append((page, url, *H.blocks(source)))
                    size += len(group[-1][2]) + 1
                    if size >= TOGETHER:
                        yield out(group)
                        group, size = [], 0
        if group:
            yield out(group)
    return run


def label(pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    """(page_id, url, blocks, scores): the leaf blocks of each page and their scores, above 0 for main text."""
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(
        _label(model or fitted()), "page_id long, url string, blocks array<string>, scores array<float>")


def extract(pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    """(page_id, url, text, n_chars, n_blocks, n_kept) for every row of ``pages``.

    Text: the main-text blocks in page order, joined by one line feed; empty if there are none. A null or empty
    html, or one without text, gives an empty text. Null ids and urls stay null; repeated rows give repeated
    results; other columns may have any name. Pages of any length are read whole: one page and its vectors
    (about 1 KB a block) are held at a time. An empty table gives an empty result."""
    kept = F.transform(F.filter(F.arrays_zip("blocks", "scores"), lambda b: b["scores"] > 0), lambda b: b["blocks"])
    out = label(pages, model).select("page_id", "url", "blocks", kept.alias("kept"))
    text = F.array_join("kept", "\n")
    return out.select("page_id", "url", text.alias("text"), F.char_length(text).cast("long").alias("n_chars"), F.size("blocks").alias("n_blocks"), F.size("kept").alias("n_kept"))
