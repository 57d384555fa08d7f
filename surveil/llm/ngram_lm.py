"""Language-model scores by stupid backoff, computed from count tables partitioned by hash.

Each word is scored by the corpus without its own document:
  S(w | v) = (c(v w) - own(v w)) / (c(v .) - own(v .))   if another document has the bigram v w,
           = ALPHA * (c(w) - own(w) + 1) / (N - n + 1)   otherwise,
with counts over all documents, own the document's own counts, N all words and n the document's.
A document's first word has the start mark as context.

1. Word table: word -> (count, count as a context), pre-aggregated per task.
2. Exploded bigrams (document, v, w, tf) meet the bigram table in one shuffle: they are dealt by the
   hash of the context v, so a task sees all of v's bigrams and sums c(v w) and c(v .) from them.
   Contexts with more than a quarter of a partition's words are dealt by the hash of (v, w); their
   context counts come from the word table (fewer than 4 x partitions words can be that frequent,
   which bounds the broadcast). A bigram with more than a quarter of a partition's words is not dealt
   at all: its two words are that frequent too, so a pass over the frequent words counts such bigrams
   (pre-aggregated per task, fewer than 4 x partitions of them), and each task scores its own entries
   from the broadcast counts. So no task receives a group that grows with the corpus.
3. Bigrams that no other document has go on to the word table, dealt by the hash of w.
4. Terms are summed per document in every task, dealt by the hash of the document and summed again.
   They are fixed-point integers, so the sums do not depend on task order.

Between stages entries travel as sorted, byte-plane, zstd-compressed blocks (one per task and
partition) instead of a row per n-gram. The number of partitions follows the number of words. A
bigram entry carries its document's own counts of v as a context and of w as differences from tf,
which are mostly zero and compress to almost nothing.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveil.llm import text as X
from surveil.session import stored

ALPHA = 0.4
FLUSH = 1_500_000        # words a task holds before it sends blocks
PER_PARTITION = 2_500_000
FIXED = 1 << 24          # fixed-point scale of log terms
START = np.uint64(1)     # context of a document's first word
_SHIFT = np.uint64(8)    # words are 56-bit hashes


def pack(*columns: np.ndarray) -> bytes:
    """Integer columns of one length as zstd-compressed byte planes."""
    n = len(columns[0])
    z = zstandard.ZstdCompressor(level=1)
    raw = b"".join(np.ascontiguousarray(c, np.int64).view(np.uint8).reshape(n, 8).T.tobytes() for c in columns)
    return struct.pack("<q", n) + z.compress(raw)


def unpack(data: bytes) -> list[np.ndarray]:
    n = struct.unpack("<q", data[:8])[0]
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[8:]), np.uint8)
    return [np.ascontiguousarray(x.reshape(8, n).T).view(np.int64).ravel() for x in raw.reshape(-1, 8 * n)] if n else []


def _mix_of(*keys: np.ndarray) -> np.ndarray:
    h = np.zeros(len(keys[0]), np.uint64)
    for k in keys:
        h = X.mix(h ^ k.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    return h


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order that sorts by the keys, first first; starts of the groups in that order)."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    return order, np.flatnonzero(new)


def _spread(values: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    return np.repeat(values, np.diff(np.append(starts, n)))


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    h, off = X.word_hashes(texts)
    return (h >> _SHIFT).astype(np.int64) | 2, off                     # never equal to START


def _word_table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, count, count as context) per task and FLUSH words."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def flush():
        w = np.concatenate([x for x, _ in held])
        ctx = np.concatenate([c for _, c in held])
        order, at = _groups(w)
        # the start mark is a context only: its rows carry a zero count
        one = (w != int(START)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(w[order][at]), pa.array(np.add.reduceat(one[order], at)),
                                           pa.array(np.add.reduceat(ctx[order], at))], ["word", "n", "ctx"])
    for batch in batches:
        for a in range(0, batch.num_rows, 512):
            w, off = _words(X.as_bytes(batch.column(0).slice(a, 512)))
            if not len(w):
                continue
            ctx = np.ones(len(w), np.int64)
            ctx[off[1:][np.diff(off) > 0] - 1] = 0                     # last words precede nothing
            full = int((np.diff(off) > 0).sum())
            held.append((np.concatenate([w, np.full(full, int(START))]), np.concatenate([ctx, np.ones(full, np.int64)])))
            size += len(w)
            if size >= FLUSH:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


def _bigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, context, word) of each word."""
    w, off = _words(texts)
    v = np.concatenate([[0], w[:-1]])[:len(w)]
    v[off[:-1][np.diff(off) > 0]] = int(START)
    return np.repeat(np.arange(len(off) - 1), np.diff(off)), v, w


def _frequent_pairs(hot: np.ndarray):
    """(v, w, count) of the bigrams of two frequent words, per task and FLUSH words."""
    def flush(held: list) -> pa.RecordBatch:
        v, w, n = (np.concatenate(c) for c in zip(*held))
        order, at = _groups(v, w)
        return pa.RecordBatch.from_arrays([pa.array(v[order][at]), pa.array(w[order][at]), pa.array(np.add.reduceat(n[order], at))], ["v", "w", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                _, v, w = _bigrams(X.as_bytes(batch.column(0).slice(a, 512)))
                both = _place(hot, v)[0] & _place(hot, w)[0]
                v, w = v[both], w[both]
                if len(v):
                    order, at = _groups(v, w)
                    held.append((v[order][at], w[order][at], np.diff(np.append(at, len(v)))))
                    size += len(at)
                if size >= FLUSH:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)
    return run


def _place(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether x is among the sorted keys, where)."""
    i = np.minimum(np.searchsorted(keys, x), max(0, len(keys) - 1))
    return (keys[i] == x) if len(keys) else np.zeros(len(x), bool), i


def _bigram_blocks(parts: int, words: dict[int, tuple[int, int]], pairs: dict[tuple[int, int], int]):
    """(part, block) with columns v, w (both as differences), document, tf, own count of v as context and own
    count of w (both less tf); ids holds the documents. Entries of ``pairs`` become sum blocks (n set)."""
    hot = np.array(sorted(words), np.int64)
    count, context = (np.array([words[k][j] for k in hot.tolist()], np.int64) for j in (0, 1))
    pair = np.array(sorted(pairs), np.int64).reshape(-1, 2)
    key = _mix_of(pair[:, 0], pair[:, 1])
    pair, key = pair[np.argsort(key)], np.sort(key)
    pair_count = np.array([pairs[v, w] for v, w in pair.tolist()], np.int64)
    kind = [pa.int32(), pa.binary(), pa.binary(), pa.int64()]

    def known(v, w, ref, tf, octx, own):
        """(entries of frequent bigrams, their sum blocks)."""
        at = np.flatnonzero(_place(hot, v)[0] & _place(hot, w)[0]) if len(key) else np.zeros(0, np.int64)
        found, i = _place(key, _mix_of(v[at], w[at]))
        found &= (pair[i, 0] == v[at]) & (pair[i, 1] == w[at]) if len(key) else False
        at, i = at[found], i[found]
        if not len(at):
            return at, None
        tf = tf[at].astype(np.int64)
        others = pair_count[i] - tf
        c, u = context[_place(hot, v[at])[1]] - tf - octx[at], count[_place(hot, w[at])[1]] - tf - own[at] + 1
        term = np.where(others > 0, np.log(np.maximum(others, 1)) - np.log(np.maximum(c, 1)), math.log(ALPHA) + np.log(np.maximum(u, 1)))
        return at, _sum_blocks(ref[at], _fixed(term) * tf, tf * (others > 0), parts)

    def flush(held: list) -> Iterator[pa.RecordBatch]:
        cols = [np.concatenate(c) for c in zip(*held)]
        done, sums = known(*cols)
        if sums is not None:
            yield sums
            cols = [np.delete(c, done) for c in cols]
        if blocks := list(dealt(*cols)):
            part, data, ids = zip(*blocks)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((part, data, ids, [None] * len(part)), kind)], ["part", "data", "ids", "n"])

    def dealt(v, w, ref, tf, octx, own) -> Iterator[tuple[int, bytes, bytes]]:
        p = np.where(np.isin(v, hot), _mix_of(v, w), _mix_of(v)) % np.uint64(parts)
        order = np.lexsort((ref, w, v, p))
        cut = np.searchsorted(p[order], np.arange(parts + 1).astype(np.uint64))
        for i in range(parts):
            at = order[cut[i]:cut[i + 1]]
            if len(at):
                ids, of = np.unique(ref[at], return_inverse=True)
                yield i, pack(np.diff(v[at], prepend=0), np.diff(w[at], prepend=0), of, tf[at], octx[at], own[at]), pack(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            refs = batch.column(0).to_numpy()
            for a in range(0, batch.num_rows, 512):
                doc, v, w = _bigrams(X.as_bytes(batch.column(1).slice(a, 512)))
                if not len(w):
                    continue
                order, at = _groups(doc, v, w)                          # one entry per document and bigram
                tf = np.diff(np.append(at, len(w)))
                d, v, x = doc[order][at], v[order][at], w[order][at]
                _, s = _groups(d, v)                                    # already in this order
                octx = _spread(np.add.reduceat(tf, s), s, len(d))
                o, s = _groups(d, x)
                own = np.empty(len(d), np.int64)
                own[o] = _spread(np.add.reduceat(tf[o], s), s, len(d))
                held.append((v, x, refs[a:a + 512][d], *(c.astype(np.int32) for c in (tf, octx - tf, own - tf))))
                size += len(w)
                if size >= FLUSH:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)
    return run


def _fixed(x: np.ndarray) -> np.ndarray:
    return np.rint(x * FIXED).astype(np.int64)


def _scored_bigrams(parts: int, hot: dict[int, tuple[int, int]]):
    """Blocks of whole partitions -> blocks of sums per document (n set) and of unseen words; sum blocks that
    came along are merged."""
    keys = np.array(sorted(hot), np.int64)
    count = np.array([hot[k][0] for k in keys.tolist()], np.int64)
    context = np.array([hot[k][1] for k in keys.tolist()], np.int64)

    def part(blocks: list[tuple[bytes, bytes]]) -> Iterator[pa.RecordBatch]:
        cols, refs = [], []
        for data, ids in blocks:
            v, w, of, tf, octx, own = unpack(data)
            cols.append((np.cumsum(v), np.cumsum(w), tf, octx.astype(np.int32), own.astype(np.int32)))
            refs.append(unpack(ids)[0][of])
        v, w, tf, octx, own = (np.concatenate(c) for c in zip(*cols))
        ref = np.concatenate(refs)
        del cols, refs
        order, s = _groups(v, w)
        v, w, tf, ref, octx, own = (x[order] for x in (v, w, tf, ref, octx, own))
        c2 = _spread(np.add.reduceat(tf, s), s, len(v))
        _, s = _groups(v)
        ctx = _spread(np.add.reduceat(tf, s), s, len(v))
        is_hot, i = _place(keys, v)
        if len(keys):
            ctx = np.where(is_hot, context[i], ctx)
        seen = c2 > tf
        # (log of a count of 0 is never taken: a seen bigram has another document's context too)
        term = np.where(seen, np.log(np.maximum(c2 - tf, 1)) - np.log(np.maximum(ctx - tf - octx, 1)), math.log(ALPHA))
        del c2, ctx, octx
        w_hot, i = _place(keys, w)
        now = ~seen & w_hot
        if now.any():
            term = np.where(now, term + np.log(np.maximum(count[i] - tf - own + 1, 1)), term)
        value = _fixed(term) * tf
        yield _sum_blocks(ref, value, tf * seen, parts)
        ask = ~seen & ~w_hot
        if ask.any():
            w, ref, tf, own = w[ask], ref[ask], tf[ask], own[ask]
            p = _mix_of(w) % np.uint64(parts)
            order = np.lexsort((ref, w, p))
            cut = np.searchsorted(p[order], np.arange(parts + 1).astype(np.uint64))
            out = []
            for i in range(parts):
                at = order[cut[i]:cut[i + 1]]
                if len(at):
                    ids, of = np.unique(ref[at], return_inverse=True)
                    out.append((i, pack(np.diff(w[at], prepend=0), of, tf[at], own[at]), pack(ids)))
            p, data, ids = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(data, pa.binary()), pa.array(ids, pa.binary()),
                                              pa.nulls(len(p), pa.int64())], ["part", "data", "ids", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blocks in _by_part(batches):
            if terms := _terms(blocks):
                yield _sum_blocks(*terms, parts)
                del terms
            if entries := [(data, ids) for data, ids, n in blocks if n is None]:
                yield from part(entries)
    return run


def _sum_blocks(ref: np.ndarray, value: np.ndarray, seen: np.ndarray, parts: int) -> pa.RecordBatch:
    """Terms summed per document, as blocks dealt by the hash of the document (n set)."""
    order, s = _groups(ref)
    ref, value, seen = ref[order][s], np.add.reduceat(value[order], s), np.add.reduceat(seen[order], s)
    p = (_mix_of(ref) % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((ref, p))
    cut = np.searchsorted(p[order], np.arange(parts + 1))
    rows = [(i, pack(value[at], seen[at]), pack(np.diff(ref[at], prepend=0)), len(at)) for i in range(parts) if len(at := order[cut[i]:cut[i + 1]])]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary(), pa.int64()))],
                                      ["part", "data", "ids", "n"])


def _terms(blocks: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(ref, value, seen) of the sum blocks among ``blocks``."""
    cols = [(np.cumsum(unpack(ids)[0]), *unpack(d)) for d, ids, n in blocks if n is not None]
    return tuple(np.concatenate(c) for c in zip(*cols)) if cols else None


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list]]:
    """Consecutive rows of one part (the input is sorted by part), one list of blocks at a time."""
    now, blocks = None, []
    for batch in batches:
        for p, *rest in zip(*(c.to_pylist() for c in batch.columns)):
            if p != now and blocks:
                yield now, blocks
                blocks = []
            now = p
            blocks.append(tuple(rest))
    if blocks:
        yield now, blocks


def _vocabulary_blocks(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            p = (_mix_of(w) % np.uint64(parts)).astype(np.int64)
            order = np.lexsort((w, p))
            cut = np.searchsorted(p[order], np.arange(parts + 1))
            rows = [(i, pack(np.diff(w[at], prepend=0), n[at])) for i in range(parts) if len(at := order[cut[i]:cut[i + 1]])]
            if rows:
                p, data = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(data, pa.binary()), pa.nulls(len(p), pa.binary()),
                                                  pa.nulls(len(p), pa.int64())], ["part", "data", "ids", "n"])
    return run


def _scored_words(parts: int):
    """Vocabulary blocks (no ids) and unseen-word blocks of whole partitions -> sum blocks; sum blocks that
    came along are merged."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blocks in _by_part(batches):
            if terms := _terms(blocks):
                yield _sum_blocks(*terms, parts)
            words = [unpack(d) for d, ids, _ in blocks if ids is None]
            asks = [(unpack(d), unpack(ids)[0]) for d, ids, n in blocks if ids is not None and n is None]
            if not asks:
                continue
            vocab, count = (np.concatenate(c) for c in zip(*[(np.cumsum(w), c) for w, c in words]))
            order = np.argsort(vocab)
            vocab, count = vocab[order], count[order]
            w, ref, tf, own = (np.concatenate(c) for c in zip(*[(np.cumsum(w), ids[of], tf, own) for (w, of, tf, own), ids in asks]))
            yield _sum_blocks(ref, _fixed(np.log(count[np.searchsorted(vocab, w)] - tf - own + 1)) * tf, np.zeros(len(ref), np.int64), parts)
    return run


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum blocks of whole document partitions -> one row per document."""
    for _, blocks in _by_part(batches):
        ref, value, seen = _terms(blocks)
        order, s = _groups(ref)
        yield pa.RecordBatch.from_arrays([pa.array(ref[order][s]), pa.array(np.add.reduceat(value[order], s)),
                                          pa.array(np.add.reduceat(seen[order], s))], ["ref", "value", "seen"])


def score(docs: DataFrame, per_partition: int = PER_PARTITION) -> DataFrame:
    """(doc_id, n_words, n_seen, log_score, mean_log_score) for each row of ``docs``.

    n_seen counts words whose bigram another document has; log_score is the sum of natural logs,
    mean_log_score the sum over n_words. Null or empty text: 0 words, null scores. Reads doc_id and
    text only. Rows count as documents of their own even if they repeat (so a repeated row sees its
    copy's counts); a null doc_id is scored like any row. An empty table gives an empty result."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.select("doc_id", text.alias("text"), F.xxhash64("doc_id", text).alias("ref"))
    table = stored(docs.select("text").mapInArrow(_word_table, "word long, n long, ctx long")
                   .groupBy("word").agg(F.sum("n").alias("n"), F.sum("ctx").alias("ctx")), "words")
    total = int(table.agg(F.sum("n")).first()[0] or 0)
    parts = max(1, math.ceil(total / per_partition))
    # fewer than 4 x partitions words (and the start mark) can hold such a share
    share = max(1, total // (4 * parts))
    frequent = table.filter((F.greatest("n", "ctx") > share))
    hot = {r.word: (r.n, r.ctx) for r in frequent.collect()}
    both = docs.select("text").mapInArrow(_frequent_pairs(np.array(sorted(hot), np.int64)), "v long, w long, n long")
    # both words of such a bigram are frequent, so fewer than 4 x partitions bigrams are left
    pairs = {(r.v, r.w): r.n for r in both.groupBy("v", "w").agg(F.sum("n").alias("n")).filter(F.col("n") > share).collect()} if hot else {}
    kind = "part int, data binary, ids binary, n long"
    blocks = docs.select("ref", "text").mapInArrow(_bigram_blocks(parts, hot, pairs), kind)
    first = blocks.repartitionById(parts, F.col("part")).sortWithinPartitions("part").mapInArrow(_scored_bigrams(parts, hot), kind)
    words = table.filter("n > 0").select("word", "n").mapInArrow(_vocabulary_blocks(parts), kind)
    second = first.union(words).repartitionById(parts, F.col("part")).sortWithinPartitions("part").mapInArrow(_scored_words(parts), kind)
    sums = second.repartitionById(parts, F.col("part")).sortWithinPartitions("part").mapInArrow(_documents, "ref long, value long, seen long")
    rows = docs.select("doc_id", "ref", F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+")).cast("long").alias("n_words"))
    copies = rows.groupBy("ref").agg(F.count("*").alias("copies"))
    out = rows.join(copies, "ref").join(sums, "ref", "left")
    unseen = F.col("n_words") - F.col("seen") / F.col("copies")
    log = F.col("value") / F.col("copies") / float(FIXED) - unseen * F.log(F.lit(float(total + 1)) - F.col("n_words"))
    out = out.withColumn("log_score", F.when(F.col("n_words") > 0, log))
    return out.select("doc_id", "n_words", F.coalesce((F.col("seen") / F.col("copies")).cast("long"), F.lit(0).cast("long")).alias("n_seen"),
                      "log_score", (F.col("log_score") / F.col("n_words")).alias("mean_log_score"))
