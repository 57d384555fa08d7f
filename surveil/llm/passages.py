"""Removal of repeated passages by longest-previous-factor arrays over a sampled suffix order.

A byte goes if a ``width``-byte string covering it also starts earlier (smaller doc_id, or the same
document at an earlier start). Only matches of at least ``width`` bytes count, so the corpus is not
sorted whole:

1. Anchors. In every ``width``-byte window the ``GRAM``-gram with the smallest hash (leftmost on
   ties) is an anchor. Equal windows have equal anchors at equal offsets, so a window can only
   match windows of the same anchor gram. A window belongs to its anchor.
2. An anchor's context is the bytes of all its windows. Rows (gram hash, context hash, place) are
   dealt by gram and streamed in order: of equal contexts only the earliest can hold a first
   occurrence, all others are removed over the whole context. Copies within one Arrow batch are
   settled before the shuffle, so a passage with very many copies sends a row per batch to its
   gram's task.
3. Where one gram has several different contexts, their bytes are suffix-sorted together in tasks
   (prefix doubling to ``width`` bytes, positions in corpus order breaking ties). In that order the
   longest previous factor of a position is the larger LCP with its previous and its next smaller
   position; being at least ``width`` is what removes it. The first copy always stays.
   Contexts beyond ``GROUP`` of one gram do not go to one task: the windows of such a gram are
   grouped by window hash, with a partial minimum of the place before the shuffle.
4. Removed runs per document are joined, and the rest of the bytes is kept.

Texts are shuffled twice (to cut contexts, to apply the runs) and travel zstd-compressed. A place is
(doc_id, start, tag): the tag, 20 bits of the text's hash, tells rows apart that share a doc_id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveil.llm import text as X
from surveil.session import stored

WIDTH = 100
GRAM = 24
GROUP = 20_000           # contexts of one gram that one task sorts
PIECE = 1 << 20          # bytes hashed at a time
CHUNK = 1 << 21          # bytes of contexts sorted at a time (at least one whole gram)
TAG = 20                 # bits

_rng = np.random.Generator(np.random.PCG64(1976))
_VALUE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_MUL = np.uint64(0x9E3779B97F4A7C15)


def _inverse_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inv = pow(int(_MUL), -1, 2**64)
    up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _MUL, np.uint64)]))
    down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(inv), np.uint64)]))
    return up, down


_UP, _DOWN = _inverse_powers(PIECE + 4 * WIDTH)


class Hashes:
    """Hash of any byte range of a buffer: polynomial prefix sums mod 2**64, mixed."""

    def __init__(self, data: bytes):
        v = _VALUE[np.frombuffer(data, np.uint8)]
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(v * _UP[:len(v)])])

    def of(self, start, end) -> np.ndarray:
        start, end = np.asarray(start), np.asarray(end)
        return X.mix((self.sums[end] - self.sums[start]) * _DOWN[start] + (end - start).astype(np.uint64))


def window_anchors(data: bytes, width: int = WIDTH, gram: int = GRAM) -> np.ndarray:
    """Anchor position of the window starting at each position 0 .. len - width."""
    n = len(data)
    if n < width:
        return np.empty(0, np.int64)
    out = []
    span = width - gram + 1                                  # grams per window
    for a in range(0, n - width + 1, PIECE):
        b = min(n, a + PIECE + width - 1)
        h = Hashes(data[a:b])
        pos = np.arange(b - a - gram + 1)
        out.append(_leftmost_min(h.of(pos, pos + gram), span)[:min(PIECE, n - width + 1 - a)] + a)
    return np.concatenate(out)


def _leftmost_min(g: np.ndarray, span: int) -> np.ndarray:
    """Index of the leftmost minimum of each run of ``span`` values (blocks of prefix and suffix minima)."""
    m = len(g)
    pad = -m % span
    full = np.concatenate([g, np.full(pad, np.uint64(2**64 - 1))]).reshape(-1, span)
    pre = np.minimum.accumulate(full, 1)
    # leftmost index of each running minimum
    fresh = np.concatenate([np.ones((len(full), 1), bool), full[:, 1:] < pre[:, :-1]], 1)
    base = np.arange(len(full) * span).reshape(-1, span)
    pre_at = np.maximum.accumulate(np.where(fresh, base, 0), 1).ravel()
    back = full[:, ::-1]
    suf = np.minimum.accumulate(back, 1)
    fresh = np.concatenate([np.ones((len(full), 1), bool), back[:, 1:] <= suf[:, :-1]], 1)
    # running over the reversed row, the last index that set the minimum (<=) is the leftmost one
    step = np.where(fresh, np.arange(span)[None, :], 0)
    at = np.maximum.accumulate(step, 1)
    suf_at = (base[:, -1:] - at)[:, ::-1].ravel()
    i = np.arange(m - span + 1)
    left, right = suf_at[i], pre_at[i + span - 1]
    flat = full.ravel()
    return np.where(flat[right] < flat[left], right, left)


def anchors(data: bytes, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, last window): the windows of an anchor are consecutive starts."""
    at = window_anchors(data, width, gram)
    if not len(at):
        return at, at, at
    cut = np.flatnonzero(np.diff(at)) + 1
    first = np.concatenate([[0], cut])
    return at[first], first, np.concatenate([cut, [len(at)]]) - 1


def _range_hashes(data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of short byte ranges of ascending start, a piece of the text at a time."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        a = int(start[i])
        j = int(np.searchsorted(start, a + PIECE))
        h = Hashes(data[a:int(end[i:j].max())])
        out[i:j] = h.of(start[i:j] - a, end[i:j] - a)
        i = j
    return out


def _batch_rows(width: int, gram: int):
    """(k, context, doc_id, at, size) per anchor; at = start << TAG | tag. A context that another
    instance of the same batch precedes is settled: size negative, k spread over all tasks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, tags = batch.column(0).to_pylist(), X.as_bytes(batch.column(1)), batch.column(2).to_pylist()
            part, rows = [], 0
            for doc, data, tag in zip(ids, texts, tags):
                a, lo, hi = anchors(data, width, gram)
                if not len(a):
                    continue
                context = _range_hashes(data, lo, hi + width) ^ X.mix((a - lo).astype(np.uint64) + np.uint64(7))
                part.append((_range_hashes(data, a, a + gram), context, np.full(len(a), doc, np.int64), lo << TAG | tag, hi + width - lo))
                rows += len(a)
                if rows >= 100_000:
                    yield _settled(part)
                    part, rows = [], 0
            if part:
                yield _settled(part)
    return run


def _settled(part: list) -> pa.RecordBatch:
    k, context, doc, at, size = (np.concatenate(c) for c in zip(*part))
    order = np.lexsort((at, doc, context, k))
    k, context, doc, at, size = k[order], context[order], doc[order], at[order], size[order]
    same = np.concatenate([[False], (k[1:] == k[:-1]) & (context[1:] == context[:-1])])
    size = np.where(same, -size, size)
    k = np.where(same, X.mix(doc.view(np.uint64) ^ at.view(np.uint64)), k)
    # one document twice in the batch (repeated rows) is the same place, not an earlier one
    again = np.concatenate([[False], same[1:] & (doc[1:] == doc[:-1]) & (at[1:] == at[:-1])])
    keep = ~again
    return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (k.view(np.int64), context.view(np.int64), doc, at, size.astype(np.int32))],
                                      ["k", "context", "doc_id", "at", "size"])


def _stream(limit: int):
    """Rows sorted by (k, context, doc_id, at) -> (kind, gram, doc_id, at, size): kind 0 is a removed run,
    1 a first context of a gram that has others, 2 the same for a gram with more than ``limit``."""
    def out(kind, k, doc, at, size):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k), pa.array(doc), pa.array(at),
                                           pa.array(size.astype(np.int32))], ["kind", "gram", "doc_id", "at", "size"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.int32)]   # first contexts of the open gram
        hot = None                                                                             # the open gram, once over the limit
        for batch in batches:
            k, c, d, a, s = (batch.column(i).to_numpy() for i in range(5))
            done = s < 0
            if done.any():
                yield out(0, k[done], d[done], a[done], -s[done])
                k, c, d, a, s = (x[~done] for x in (k, c, d, a, s))
            if not len(k):
                continue
            n = len(held[0])
            k, c, d, a, s = (np.concatenate([h, x]) for h, x in zip(held, (k, c, d, a, s)))
            new = np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])])
            rep = np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))
            gone = ~new & ((d != d[rep]) | (a != a[rep]))
            gone[:n] = False
            if gone.any():
                yield out(0, k[gone], d[gone], a[gone], s[gone])
            old = np.arange(len(k)) < n
            k, c, d, a, s, old = (x[new] for x in (k, c, d, a, s, old))
            starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            many = np.repeat(np.diff(np.append(starts, len(k))) > 1, np.diff(np.append(starts, len(k))))
            last = starts[-1]
            if hot is not None:
                mine = (k == hot) & ~old                       # the held row of a hot gram was given out before
                if mine.any():
                    yield out(2, k[mine], d[mine], a[mine], s[mine])
                many &= k != hot
                if k[last] != hot:
                    hot = None
            ready = many.copy()
            ready[last:] = False
            if ready.any():
                yield out(1, k[ready], d[ready], a[ready], s[ready])
            held = [x[last:] for x in (k, c, d, a, s)]
            if hot is None and len(held[0]) > limit:
                hot = int(k[last])
                yield out(2, *(held[i] for i in (0, 2, 3, 4)))
            if hot is not None:
                held = [x[-1:] for x in held]                  # only to recognise the next context
        if hot is None and len(held[0]) > 1:
            yield out(1, *(held[i] for i in (0, 2, 3, 4)))
    return run


def _compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    z = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        texts = pa.array([z.compress(t) for t in X.as_bytes(batch.column(1))], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), texts, batch.column(2)], ["doc_id", "z", "tag"])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut the wanted byte ranges out of each document."""
    z = zstandard.ZstdDecompressor()
    for batch in batches:
        rows, size = [], 0
        for doc, data, wanted in zip(*(batch.column(i).to_pylist() for i in range(3))):
            data = z.decompress(data)
            for w in wanted:
                lo = w["at"] >> TAG
                rows.append((w["gram"], doc, w["at"], w["kind"] == 2, data[lo:lo + w["size"]]))
                size += w["size"]
            if size > 1 << 22:
                yield _taken(rows)
                rows, size = [], 0
        if rows:
            yield _taken(rows)


def _taken(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()))],
                                      ["gram", "doc_id", "at", "hot", "bytes"])


def suffix_ranks(buf: np.ndarray, ends: np.ndarray, depth: int) -> np.ndarray:
    """Rank of each position's string of up to ``depth`` bytes, cut at its context's end (exclusive).

    Equal ranks mean equal strings of equal length. Seven bytes are ranked at once, then prefix
    doubling: a string of 2h bytes is ordered by the ranks of its halves."""
    n = len(buf)
    pos = np.arange(n)
    key = np.zeros(n, np.int64)
    byte = buf.astype(np.int64) + 1
    for j in range(7):
        key = key * 257 + np.where(pos + j < ends, byte[np.minimum(pos + j, n - 1)], 0)
    have = 7
    while True:
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[1], key[order][1:] != key[order][:-1]]))
        if have >= depth:
            return rank
        step = min(have, depth - have)
        nxt = pos + step                                       # overlapping halves still cover the string
        key = rank * (n + 1) + np.where(nxt < ends, rank[np.minimum(nxt, n - 1)], 0)
        have += step


def previous_factors(buf: np.ndarray, ends: np.ndarray, place: np.ndarray, width: int) -> np.ndarray:
    """True where the ``width``-byte string at a position also starts at a smaller place (LPF >= width).

    Suffix order: by string of ``width`` bytes, then by place. The previous and next smaller places
    of an entry are found in that order; among equal strings the places ascend, so the previous
    smaller one, if its LCP reaches ``width``, is the entry just before, and the next smaller one
    lies past the run of equal strings, where the LCP is shorter."""
    whole = np.flatnonzero(np.arange(len(buf)) + width <= ends)
    rank = suffix_ranks(buf, ends, width)[whole]
    order = np.lexsort((place[whole], rank))
    r, p = rank[order], place[whole][order]
    lcp = np.concatenate([[False], r[1:] == r[:-1]])           # LCP with the entry before reaches width
    smaller = np.concatenate([[False], p[:-1] < p[1:]])        # equal places: the same window seen twice
    out = np.zeros(len(buf), bool)
    out[whole[order]] = lcp & smaller
    return out


def _sorted_chunk(rows: list, width: int) -> pa.RecordBatch | None:
    """Removed windows of whole gram groups, neighbouring ones joined: (doc_id, at, size)."""
    _, doc, at, data = zip(*rows)
    size = np.array([len(d) for d in data])
    buf = np.frombuffer(b"".join(data), np.uint8)
    first = np.cumsum(size) - size
    doc, at = np.repeat(np.array(doc, np.int64), size), np.repeat(np.array(at, np.int64), size)
    at = at + ((np.arange(len(buf)) - np.repeat(first, size)) << TAG)
    order = np.lexsort((at, doc))
    place = np.empty(len(buf), np.int64)
    place[order] = np.cumsum(np.concatenate([[0], (np.diff(doc[order]) != 0) | (np.diff(at[order]) != 0)]))
    gone = np.flatnonzero(previous_factors(buf, np.repeat(first + size, size), place, width))
    if not len(gone):
        return None
    return _joined(doc[gone], at[gone], width)


def _joined(doc: np.ndarray, at: np.ndarray, width: int) -> pa.RecordBatch:
    order = np.lexsort((at, at & ((1 << TAG) - 1), doc))
    doc, at = doc[order], at[order]
    new = np.concatenate([[True], (np.diff(doc) != 0) | (np.diff(at) > (width << TAG)) | (np.diff(at & ((1 << TAG) - 1)) != 0)])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(at)) - 1
    return pa.RecordBatch.from_arrays([pa.array(doc[head]), pa.array(at[head]), pa.array(((at[tail] - at[head]) >> TAG) + width)],
                                      ["doc_id", "at", "size"])


def _sort_contexts(width: int):
    """Contexts in gram order, a chunk of whole gram groups at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if size >= CHUNK and row[0] != rows[-1][0]:
                    if (got := _sorted_chunk(rows, width)) is not None:
                        yield got
                    rows, size = [], 0
                rows.append(row)
                size += len(row[3])
        if rows and (got := _sorted_chunk(rows, width)) is not None:
            yield got
    return run


def _windows(width: int):
    """(hash, doc_id, at) of every window of the contexts of hot grams."""
    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                h, d, s = [], [], []
                for doc, at, data in zip(*(batch.column(i).slice(a, 4096).to_pylist() for i in range(3))):
                    i = np.arange(len(data) - width + 1)
                    h.append(Hashes(data).of(i, i + width))
                    d.append(np.full(len(i), doc, np.int64))
                    s.append(at + (i << TAG))
                if h:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(h).view(np.int64)), pa.array(np.concatenate(d)),
                                                      pa.array(np.concatenate(s))], ["h", "doc_id", "at"])
    return run


def cut(runs: list | None, data: bytes) -> tuple[int, int, bytes]:
    """(removed bytes, removed runs, kept bytes) after joining overlapping or touching runs (start, end)."""
    joined: list[list[int]] = []
    for a, b in sorted(runs or []):
        if joined and a <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], b)
        else:
            joined.append([a, b])
    out, at = [], 0
    for a, b in joined:
        out.append(data[at:a])
        at = b
    out.append(data[at:])
    return sum(b - a for a, b in joined), len(joined), b"".join(out)


def _applied(with_bytes: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for data, runs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data = z.decompress(data)
                gone, n, kept = cut([(r["at"] >> TAG, (r["at"] >> TAG) + r["size"]) for r in runs or []], data)
                rows.append((len(data), gone, n, hashlib.sha256(kept).hexdigest(), kept if with_bytes else None))
            cols = zip(*rows) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))]],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
    return run


def removed_runs(texts: DataFrame, packed: DataFrame, width: int, gram: int, group: int) -> DataFrame:
    """(doc_id, tag, runs array<struct<at,size>>) of the documents that lose bytes."""
    rows = texts.filter("doc_id is not null").mapInArrow(_batch_rows(width, gram), "k long, context long, doc_id long, at long, size int")
    found = stored(rows.repartition("k").sortWithinPartitions("k", "context", "doc_id", "at").mapInArrow(
        _stream(group), "kind int, gram long, doc_id long, at long, size int"), "anchors")
    tag = F.col("at").bitwiseAND((1 << TAG) - 1).alias("tag")
    wanted = (found.filter("kind > 0").groupBy("doc_id", tag)                    # bounded by the document
              .agg(F.collect_list(F.struct("gram", "at", "kind", "size")).alias("wanted")))
    contexts = stored(packed.join(wanted.hint("merge"), ["doc_id", "tag"]).select("doc_id", "z", "wanted").mapInArrow(
        _contexts, "gram long, doc_id long, at long, hot boolean, bytes binary"), "contexts")
    cold = (contexts.filter("not hot").select("gram", "doc_id", "at", "bytes").repartition("gram").sortWithinPartitions("gram", "doc_id", "at")
            .mapInArrow(_sort_contexts(width), "doc_id long, at long, size long"))
    windows = contexts.filter("hot").select("doc_id", "at", "bytes").mapInArrow(_windows(width), "h long, doc_id long, at long")
    place = F.struct("doc_id", "at")
    first = windows.groupBy("h").agg(F.min(place).alias("first"))
    hot = windows.join(first, "h").filter(place > F.col("first")).select("doc_id", "at", F.lit(width).cast("long").alias("size"))
    runs = found.filter("kind = 0").select("doc_id", "at", F.col("size").cast("long").alias("size")).union(cold).union(hot)
    return runs.groupBy("doc_id", tag).agg(F.collect_list(F.struct("at", "size")).alias("runs"))


def remove(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, group: int = GROUP, with_bytes: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) for each row of ``docs``.

    ``kept`` are the remaining bytes (a cut may fall inside a character, hence bytes). Reads doc_id
    and text only. Null text is empty. A null doc_id has no place in the order: its row neither
    loses bytes nor removes any. Rows sharing a doc_id: equal texts are one document and share the
    answer; different texts are ordered by start, then by a hash of the text. An empty table gives
    an empty result."""
    tag = F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND((1 << TAG) - 1).alias("tag")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), tag)
    packed = texts.mapInArrow(_compressed, "doc_id long, z binary, tag long")
    runs = removed_runs(texts, packed, width, gram, group).withColumnsRenamed({"doc_id": "d", "tag": "t"})
    out = packed.join(stored(runs, "runs").hint("merge"), (F.col("doc_id") == F.col("d")) & (F.col("tag") == F.col("t")), "left")
    out = out.select("doc_id", "z", "runs").mapInArrow(
        _applied(with_bytes), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out if with_bytes else out.drop("kept")
