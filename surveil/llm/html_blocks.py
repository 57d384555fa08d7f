"""HTML pages as sequences of leaf blocks, and the vectors that describe each block.

A block is the text between two borders of block-level elements; inline elements and line breaks do not
end one. Comments, declarations and the content of scripts, styles and other raw-text elements hold no
text. Character references are decoded, white space is turned into one space and trimmed. Missing end
tags close where HTML closes them (paragraphs, list items, cells); an end tag without a start is ignored.
"""

from __future__ import annotations

import html
import re
import zlib
from functools import lru_cache

import numpy as np

# fixed values: element names of HTML
BLOCK = frozenset("""address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option
p pre search section select summary table tbody td template tfoot th thead tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp svg math object".split())
CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"),
          "th": ("td th", "tr table"), "option": ("option", "select"), "thead": ("tbody thead tfoot tr td th", "table"),
          "tbody": ("tbody thead tfoot tr td th", "table"), "tfoot": ("tbody thead tfoot tr td th", "table")}
CLOSES = {k: (frozenset(names.split()), frozenset(scope.split())) for k, (names, scope) in CLOSES.items()}
PARAGRAPH = (frozenset(["p"]), frozenset("button table td th caption".split()))

PATH, NEAR, WORDS, DENSE = 96, 48, 64, 10
SIZE = PATH + NEAR + WORDS + DENSE

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_END = re.compile(r"[>\"']")
_ATTR = re.compile(r"""([^\s=/>"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*))|\s(hidden)\b""")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_WORD = re.compile(r"\w+|[©»«›‹|·•→←]")
_DIGIT = re.compile(r"\d")
_STOPS = re.compile(r"[.!?;:…]")


@lru_cache(maxsize=1 << 16)
def _slot(token: str, size: int) -> tuple[int, float]:
    h = zlib.crc32(token.encode("utf-8", "surrogatepass"))
    return h % size, 1.0 if h >> 31 else -1.0


@lru_cache(maxsize=1 << 17)
def _signed(word: str) -> int:
    """Slot of a word, in the second half for a negative sign."""
    k, s = _slot(word, WORDS)
    return k if s > 0 else k + WORDS


def _tag_end(page: str, at: int) -> int:
    """Index of the > that ends the tag; quotes count after an equals sign. -1: the page ends inside the tag."""
    while m := _END.search(page, at):
        if m.group() == ">":
            return m.start()
        at = m.end()
        if page[:m.start()][-64:].rstrip().endswith("="):
            close = page.find(m.group(), at)
            if close < 0:
                return page.find(">", at)
            at = close + 1
    return -1


def _tokens(name: str, attributes: str) -> list[str]:
    out = [f"t:{name}"]
    for m in _ATTR.finditer(attributes):
        if m.group(5):
            out.append("hidden")
            continue
        key, value = m.group(1).lower(), m.group(2) or m.group(3) or m.group(4) or ""
        if key in ("class", "id", "role", "itemprop", "aria-label"):
            out += [f"c:{w.lower()}" for w in _PARTS.findall(value)]
        elif key == "aria-hidden" and value == "true" or key == "style" and "none" in value:
            out.append("hidden")
    return out


@lru_cache(maxsize=1 << 13)
def _described(name: str, attributes: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed tokens of an element, for its path and for itself."""
    path, own = np.zeros(PATH, np.float32), np.zeros(NEAR, np.float32)
    for t in _tokens(name, attributes):
        k, s = _slot(t, NEAR)
        own[k] += s
        k, s = _slot(t + "/", PATH)
        path[k] += s
    return path, own


class _Open:
    """An open element: its name, the hashed tokens of its path, and of itself and its parent."""
    __slots__ = ("name", "own", "path", "near")

    def __init__(self, name: str, attributes: str, parent: "_Open | None"):
        self.name = name
        path, self.own = _described(name, attributes)
        self.path = parent.path + path if parent else np.zeros(PATH, np.float32)
        self.near = self.own + np.float32(.5) * parent.own if parent else self.own


def blocks(page: str | None) -> tuple[list[str], np.ndarray]:
    """Texts of the leaf blocks in page order, and their vectors (a row each)."""
    page = page or ""
    root = _Open("#", "", None)
    stack: list[_Open] = [root]                    # block-level elements only
    inline: list[str] = []
    out: list[tuple[str, _Open, int, int]] = []
    buf: list[str] = []
    linked: list[int] = [0, 0]                     # characters inside links, inline elements

    def flush() -> None:
        text = " ".join(html.unescape("".join(buf)).split())
        if text:
            out.append((text, stack[-1], linked[0], linked[1]))
        buf.clear()
        linked[:] = [0, 0]

    def leave(names: frozenset, scope: frozenset) -> None:
        i = top = len(stack)
        while i > 1 and stack[i - 1].name not in scope:
            i -= 1
            if stack[i].name in names:
                top = i
        del stack[top:]

    def say(text: str) -> None:
        buf.append(text)
        if "a" in inline:
            linked[0] += len(text)

    at = 0
    while at < len(page):
        lt = page.find("<", at)
        if lt < 0:
            say(page[at:])
            break
        if lt > at:
            say(page[at:lt])
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = len(page) if end < 0 else end + 3
            continue
        closing = page.startswith("</", lt)
        m = _NAME.match(page, lt + 1 + closing)
        if not m:
            if page[lt + 1:lt + 2] in ("!", "?", "/"):
                end = page.find(">", lt)
                at = len(page) if end < 0 else end + 1
            else:
                say("<")
                at = lt + 1
            continue
        name, end = m.group().lower(), _tag_end(page, m.end())
        if end < 0:
            break                                  # the page ends inside a tag
        at = end + 1
        if closing:
            if name in BLOCK:
                flush()
                inline.clear()
                if any(e.name == name for e in stack):
                    while stack[-1].name != name:
                        stack.pop()
                    stack.pop()
            elif name in inline:
                inline.reverse()
                inline.remove(name)
                inline.reverse()
            continue
        if name in RAW:
            close = re.compile(f"</{re.escape(name)}[\\s/>]", re.I).search(page, at)
            if close is None:
                at = len(page)
            else:
                end = page.find(">", close.start())
                at = len(page) if end < 0 else end + 1
            continue
        if name in BLOCK:
            flush()
            inline.clear()
            leave(*PARAGRAPH)
            if name in CLOSES:
                leave(*CLOSES[name])
            if name not in VOID:
                stack.append(_Open(name, page[m.end():end], stack[-1]))
        elif name in VOID:
            buf.append(" " if name in ("br", "wbr") else "")
        else:
            inline.append(name)
            linked[1] += 1
    flush()
    return [t for t, *_ in out], _vectors(out)


def _vectors(found: list[tuple[str, _Open, int, int]]) -> np.ndarray:
    n = len(found)
    v = np.zeros((n, SIZE), np.float32)
    if not n:
        return v
    np.clip(np.stack([where.path for _, where, *_ in found]), -3, 3, out=v[:, :PATH])
    np.clip(np.stack([where.near for _, where, *_ in found]), -2, 2, out=v[:, PATH:PATH + NEAR])
    slots: list[int] = []
    dense = []
    for i, (text, _, linked, inline) in enumerate(found):
        words = _WORD.findall(text.lower())
        slots += [2 * WORDS * i + _signed(x) for x in words]
        size, w = len(text), 1 + len(words)
        dense.append((size, w, linked / size, inline / w, len(_STOPS.findall(text)) / w, text.count(",") / w, text[-1] in ".!?…\"”»", len(_DIGIT.findall(text)) / size, i / n, 1.0))
    w = np.bincount(slots, minlength=2 * WORDS * n).reshape(n, 2, WORDS).astype(np.float32)
    w = w[:, 0] - w[:, 1]
    v[:, PATH + NEAR:PATH + NEAR + WORDS] = w / np.maximum(1.0, np.sqrt((w * w).sum(1)))[:, None]
    d = np.array(dense)
    d[:, 0], d[:, 1] = np.log1p(d[:, 0]) / 8, np.log(d[:, 1]) / 6
    v[:, -DENSE:] = np.minimum(d, 1.5)
    return v
