"""Phrase collocations by SON partitioning: mine shards at lowered support, then count exactly.

1. Mine. Input partitions are dealt to ``shards`` shards. A phrase with ``support`` occurrences has at
   least ceil(support / shards) of them in some shard, so every shard is counted completely (words and
   phrases of 2 and 3 words, as 64-bit hashes) and what reaches that local support there is kept. A
   shard is itself spread over tasks: each task sends one row per distinct phrase it holds, and the
   rows meet by hash.
2. Union. The locally frequent hashes of all shards set bits of a Bloom filter. Its size follows their
   number up to ``MAX_BITS`` (64 MB): that bounds the broadcast at any corpus size. A fuller filter lets
   more infrequent phrases through to step 3, it never loses one.
3. Count. The texts are read again; phrases that pass the filter are counted as strings, so hash
   collisions and false positives end here: counts are exact, and support is tested on them.

The parts of a frequent phrase are at least as frequent as it, so the same table has their counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveil.llm import text as X
from surveil.session import stored

SHARDS = 3
LONGEST = 3                     # words of the longest phrase
MIN_BITS, MAX_BITS = 20, 29     # binary logarithm of the filter's size
CHUNK = 1 << 20                 # bytes of text looked at together
HELD = 1 << 22                  # hashes a task holds before it sends their counts

_END = re.compile(rb"[.,;:!?\x0A-\x0D]")
_KIND = np.zeros(256, np.uint8)
_KIND[[9, 32]] = 1
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KEYS = np.random.Generator(np.random.PCG64(130713)).integers(0, 2**63, (2, LONGEST), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Words:
    """Words of several texts: hashes, language, piece borders, and the lower-cased words joined by single spaces."""

    def __init__(self, parts: list[tuple[int, bytes]]):
        buf = np.frombuffer(b"\n" + b"\n".join(t for _, t in parts) + b"\n", np.uint8)
        kind = _KIND[buf]
        word = kind == 0
        edge = np.flatnonzero(word[1:] != word[:-1]) + 1
        starts, ends = edge[0::2], edge[1::2]
        self.size = ends - starts
        self.n = len(starts)
        if not self.n:
            return
        body = buf[word]
        self.hash = X.run_hashes(body, self.size)
        self.piece = np.cumsum(kind == 2, dtype=np.int32)[starts]
        at = np.cumsum([1] + [len(t) + 1 for _, t in parts])
        per = np.diff(np.searchsorted(starts, at))
        self.lang = np.repeat(np.array([lang for lang, _ in parts], np.int64), per)
        self.first = np.cumsum(self.size) - self.size + np.arange(self.n)
        self.joined = np.full(len(body) + self.n, 32, np.uint8)
        self.joined[np.arange(len(body)) + np.repeat(np.arange(self.n), self.size)] = _LOWER[body]

    def phrases(self, length: int) -> np.ndarray:
        """Index of the first word of each phrase of ``length`` words."""
        m = self.n - length + 1
        return np.flatnonzero(self.piece[length - 1:] == self.piece[:m]) if m > 0 else np.empty(0, np.int64)

    def hashes(self, at: np.ndarray, length: int, langs: np.ndarray, key: int = 0) -> np.ndarray:
        h = langs[self.lang[at]] + np.uint64(length)
        for j in range(length):
            h = h + self.hash[at + j] * _KEYS[key, j]
        return X.mix(h)


def _groups(batches: Iterator[pa.RecordBatch], langs: dict[str, int]) -> Iterator[list[tuple[int, bytes]]]:
    """(language number, text) in groups of about CHUNK bytes; a longer text is cut between pieces."""
    group, size = [], 0
    for batch in batches:
        for a in range(0, batch.num_rows, 64):
            names = batch.column(0).slice(a, 64).to_pylist()
            for name, text in zip(names, X.as_bytes(batch.column(1).slice(a, 64))):
                lang, at = langs.setdefault(name, len(langs)), 0
                while at < len(text):
                    end = len(text)
                    if end - at > CHUNK and (m := _END.search(text, at + CHUNK)):
                        end = m.end()
                    group.append((lang, text[at:end]))
                    size += end - at
                    at = end
                    if size >= CHUNK:
                        yield group
                        group, size = [], 0
    if group:
        yield group


def _lang_hashes(langs: dict[str, int]) -> np.ndarray:
    sets = X.word_hashes([b"l" + bytes(name, "utf-8").hex().encode() for name in langs])[0]
    return X.mix(sets + np.uint64(1))


def _mine(shards: int):
    """(key, n): distinct phrase hashes of a task, the shard in the low bits, and their counts in it."""
    low = np.uint64((1 << (shards - 1).bit_length()) - 1)

    def counted(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, n = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
        order = np.argsort(keys)
        keys = keys[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[first], np.add.reduceat(n[order], first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        shard = np.uint64(TaskContext.get().partitionId() % shards)
        langs: dict[str, int] = {}
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out(keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for a in range(0, len(keys), 1 << 18):
                yield pa.RecordBatch.from_arrays([pa.array(keys[a:a + (1 << 18)].view(np.int64)), pa.array(n[a:a + (1 << 18)].astype(np.int32))], ["key", "n"])

        for group in _groups(batches, langs):
            words = Words(group)
            if not words.n:
                continue
            names = _lang_hashes(langs)
            keys = np.concatenate([words.hashes(words.phrases(k), k, names) for k in range(1, LONGEST + 1)])
            keys, n = np.unique(keys & ~low | shard, return_counts=True)
            held.append((keys, n))
            if sum(len(k) for k, _ in held) > HELD:
                held = [counted(held)]
                if len(held[0][0]) > HELD // 2:
                    yield from out(*held.pop())
        if held:
            yield from out(*counted(held))
    return run


def _count(bits: Broadcast, log_bits: int):
    """(lang, phrase, words, n) of the phrases that pass the filter, and each language's words as phrase '' of 0 words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(bits.value, np.uint8)
        langs: dict[str, int] = {}
        for group in _groups(batches, langs):
            words = Words(group)
            if not words.n:
                continue
            names, hashes = pa.array(list(langs), pa.string()), _lang_hashes(langs)
            total = np.bincount(words.lang, minlength=len(langs))
            some = np.flatnonzero(total)
            yield _rows(names.take(pa.array(some)), pa.array([""] * len(some), pa.string()), 0, total[some])
            for k in range(1, LONGEST + 1):
                at = words.phrases(k)
                g = words.hashes(at, k, hashes)
                for which in (0, 1):
                    bit = _bits(g, log_bits)[which]
                    hit = table[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1 == 1
                    at, g = at[hit], g[hit]
                if not len(at):
                    continue
                order = np.argsort(g, kind="stable")
                at, g = at[order], g[order]
                check = words.hashes(at, k, hashes, key=1)     # parts phrases of one hash; equal rows are added up later
                first = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (check[1:] != check[:-1])]))
                n = np.diff(np.append(first, len(g)))
                at = at[first]
                start, size = words.first[at], words.first[at + k - 1] + words.size[at + k - 1] - words.first[at]
                off = np.concatenate([[0], np.cumsum(size)])
                data = words.joined[np.repeat(start - off[:-1], size) + np.arange(off[-1])]
                phrase = pa.StringArray.from_buffers(len(at), pa.py_buffer(off.astype(np.int32)), pa.py_buffer(data))
                yield _rows(names.take(pa.array(words.lang[at])), phrase, k, n)
    return run


def _rows(lang: pa.Array, phrase: pa.Array, words: int, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([lang, phrase, pa.array(np.full(len(n), words, np.int32)), pa.array(n.astype(np.int64))], ["lang", "phrase", "words", "n"])


def _bits(g: np.ndarray, log_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bit positions of a phrase hash (its low bits carried the shard)."""
    mask = np.uint64((1 << log_bits) - 1)
    return g >> np.uint64(64 - log_bits), (g >> np.uint64(4)) & mask


def _filter(found: DataFrame, log_bits: int) -> bytes:
    """Bloom filter of the column ``key``: 2 ** log_bits bits, two of them per key."""
    a = F.shiftrightunsigned("key", 64 - log_bits)
    b = F.shiftrightunsigned("key", 4).bitwiseAND(F.lit((1 << log_bits) - 1))
    bits = found.select(F.explode(F.array(a, b)).alias("b"))
    # a bucket of the built-in bitmaps holds 32768 bits and starts at position 1
    made = bits.groupBy(F.bitmap_bucket_number(F.col("b") + 1).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("b") + 1)).alias("bits"))
    table = bytearray(1 << (log_bits - 3))
    for row in made.toLocalIterator():             # at most 2 ** MAX_BITS / 8 bytes in all
        at = (row.bucket - 1) << 12
        table[at:at + len(row.bits)] = row.bits
    return bytes(table)


def frequent(docs: DataFrame, support: int = 10, shards: int = SHARDS, max_bits: int = MAX_BITS) -> DataFrame:
    """(lang, phrase, words, a): exact counts of the words and phrases of up to 3 words that occur at least
    ``support`` times in their language, and a row of 0 words and phrase '' with each language's words."""
    if not 1 <= shards <= 16:
        raise ValueError("shards: 1 to 16 (the low four bits of a hash carry the shard)")
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    local = -(-support // shards)
    low = (1 << (shards - 1).bit_length()) - 1
    mined = texts.mapInArrow(_mine(shards), "key long, n int").repartition("key").groupBy("key").agg(F.sum("n").alias("n"))
    found = stored(mined.filter(F.col("n") >= local).select(F.col("key").bitwiseAND(F.lit(~low)).alias("key")), "locally_frequent")
    log_bits = min(max_bits, max(MIN_BITS, (16 * found.count()).bit_length()))
    bits = docs.sparkSession.sparkContext.broadcast(_filter(found, log_bits))
    counts = texts.mapInArrow(_count(bits, log_bits), "lang string, phrase string, words int, n long")
    counts = counts.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("a"))
    return stored(counts.filter((F.col("a") >= support) | (F.col("words") == 0)), "phrases")


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (l r)) in decimals of 38 digits: exact for counts below 10 ** 15."""
    big = [c.cast("decimal(15,0)") for c in (a, left, right)]
    return F.call_function("div", (big[0] * big[0]).cast("decimal(30,0)") * F.lit(1000000).cast("decimal(7,0)"), big[1] * big[2])


def mine(docs: DataFrame, support: int = 10, top: int = 2000, inside: int = 50, shards: int = SHARDS, max_bits: int = MAX_BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of 2 to 3 words of each language.

    Of ``docs`` only lang and text are read, so other columns may have any name. A null language is
    ``und`` (together with documents that say ``und``), a null text is empty; texts without words add
    nothing, and a language without candidates gives no rows; an empty table gives an empty result.
    Texts of any length are counted whole: they are cut between pieces only, and one piece is held at a
    time. Repeated rows are occurrences like any other. Ties follow the phrase in UTF-8 byte order.
    A candidate is dropped if a longer one that contains its words has ``inside`` per cent of its count."""
    table = frequent(docs, support, shards, max_bits)
    part = F.split("phrase", " ")
    cand = table.filter("words > 1").select("lang", "phrase", "words", "a", part.alias("w"))
    cuts = cand.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).select(
        "lang", "phrase", "words", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("left"),
        F.array_join(F.slice("w", F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("right"))
    parts = table.filter(F.col("words").between(1, LONGEST - 1))
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("left"), F.col("a").alias("l")), ["lang", "left"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("right"), F.col("a").alias("r")), ["lang", "right"])
    scored = cuts.withColumn("score", _score(F.col("a"), F.col("l"), F.col("r")).cast("long"))
    best = scored.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    longer = cand.filter(F.col("words") == LONGEST).select("lang", F.col("a").alias("f"), F.explode(F.array(
        F.array_join(F.slice("w", 1, LONGEST - 1), " "), F.array_join(F.slice("w", 2, LONGEST - 1), " "))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("f").alias("f"))
    kept = best.join(longer, ["lang", "phrase"], "left").filter(F.col("f").isNull() | (100 * F.col("f") < inside * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("c.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    total = table.filter("words = 0").select("lang", F.col("a").alias("n"))
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "c.l", "c.r", "n", "c.score")
