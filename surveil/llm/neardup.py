"""Near-duplicate documents by SetSketch registers, banding, joint likelihood and exact checks.

1. Sketch (numpy per Arrow batch): each document's distinct 5-word shingles give ``bands * rows``
   registers. Register i keeps the minimum of an Exp(a) hash over the set, truncated to the
   exponentially spaced value ``floor(1 - log_b(min))`` in 16 bits; registers of parts merge by max.
2. Equal sets (64+64-bit set fingerprint and size) form a class, represented by its smallest doc_id.
3. Bands: ``rows`` registers per key. Two sets with similarity J agree in a register with probability
   about J, so a linked pair misses all bands with probability (1 - J**rows)**bands < ``miss``; the
   number of bands is derived from the threshold and that bound.
4. Every member of a bucket is compared with the bucket's smallest member: linear in the bucket.
   A likelihood ratio over all registers (three outcomes per register: left larger, right larger,
   equal; set sizes known) drops pairs that are far from the threshold; the rest are confirmed on
   the full shingle sets.
5. Buckets whose other members still lie in different components are compared in blocks bounded in
   rows and in bytes of shingles. First by the stored registers and sizes alone: only members with a
   partner that the likelihood allows go on. Then their shingle sets are fetched and confirmed; pairs
   of one component are skipped, and only confirmed links leave the task.
6. Components of all confirmed links.

No bucket is capped. No task receives more than two blocks of a bucket.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveil.llm import text as X
from surveil.llm.components import components
from surveil.session import stored

BASE = 1.001            # spacing of register values
RATE = 20.0             # Exp(a) rate; P(register of a one-element set < 0) = e**-20
LLR = 11.3              # log-likelihood ratio beyond which a pair is dropped (4.75 sigma)
PAIRS = 1 << 15         # pairs whose registers are compared at once
_LOG_BASE = math.log(BASE)


def bands_for(threshold: float, rows: int = 5, miss: float = 1e-6) -> int:
    """Bands needed so that a pair at ``threshold`` shares no band with probability below ``miss``."""
    return math.ceil(math.log(miss) / math.log(1 - threshold ** rows))


def _constants(m: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(1812))
    return rng.integers(0, 2**31, m, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, m, dtype=np.uint32)


def registers(sets: list[np.ndarray], m: int) -> np.ndarray:
    """(len(sets), m) uint16 SetSketch registers; empty sets give zeros."""
    mul, add = _constants(m)
    out = np.zeros((len(sets), m), np.uint16)
    filled = [i for i, s in enumerate(sets) if len(s)]
    at = 0
    while at < len(filled):
        end, size = at, 0
        while end < len(filled) and (end == at or size + len(sets[filled[end]]) <= 1 << 18):
            size += len(sets[filled[end]])
            end += 1
        part = filled[at:end]
        off = np.cumsum([0] + [len(sets[i]) for i in part])[:-1]
        h = (np.concatenate([sets[i] for i in part]) >> np.uint64(32)).astype(np.uint32)
        low = np.empty((m, len(part)), np.uint32)
        for j in range(m):
            low[j] = np.minimum.reduceat(h * mul[j] + add[j], off)
        minima = -np.log1p(-(low + 0.5) / 2**32) / RATE
        out[part] = np.clip(np.floor(1 - np.log(minima) / _LOG_BASE), 0, 65535).T.astype(np.uint16)
        at = end
    return out


def band_keys(regs: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(n, bands) 64-bit keys of the register bands."""
    keys = np.empty((len(regs), bands), np.uint64)
    for b in range(bands):
        h = np.full(len(regs), b + 1, np.uint64)
        for r in range(rows):
            h = X.mix(h ^ (regs[:, b * rows + r].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)))
        keys[:, b] = h
    return keys


def may_reach(regs_a, regs_b, n_a, n_b, threshold: float) -> np.ndarray:
    """Pairs (rows) that the joint likelihood of their registers does not rule out at ``threshold``.

    With u = n_a / (n_a + n_b), v = 1 - u and p(x) = -log_b(1 - x (b-1)/b), a register of the first
    set is larger with probability p(u - vJ), of the second with p(v - uJ), equal otherwise.
    """
    more = (regs_a > regs_b).sum(1)
    less = (regs_a < regs_b).sum(1)
    return _allowed(more, less, regs_a.shape[1] - more - less, n_a, n_b, threshold)


def _allowed(more, less, same, n_a, n_b, threshold: float) -> np.ndarray:
    """``may_reach`` on the counts of larger, smaller and equal registers."""
    n_a, n_b = np.asarray(n_a, float), np.asarray(n_b, float)
    m = more + less + same
    u = n_a / (n_a + n_b)
    v = 1 - u
    top = np.minimum(u / v, v / u)

    def loglik(j):
        def p(x):
            return np.clip(-np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / _LOG_BASE, 1e-12, 1)
        pa_, pb = p(u - v * j), p(v - u * j)
        return more * np.log(pa_) + less * np.log(pb) + same * np.log(np.clip(1 - pa_ - pb, 1e-12, 1))

    limit = np.minimum(threshold, top)
    at_limit = loglik(limit)
    # the likelihood has one peak in J: a better J below the limit puts the peak there as well
    guess = np.minimum(same / m, top)
    keep = (top >= threshold - 1e-9) & ~((guess < limit) & (loglik(guess) - at_limit > LLR))
    left = np.flatnonzero(keep)
    more, less, same, u, v, top, at_limit = (x[left] for x in (more, less, same, u, v, top, at_limit))
    low, high = np.zeros_like(u), top.copy()
    for _ in range(40):
        x, y = low + (high - low) / 3, high - (high - low) / 3
        up = loglik(x) < loglik(y)
        low, high = np.where(up, x, low), np.where(up, high, y)
    best = (low + high) / 2
    keep[left] = (best >= threshold) | (loglik(best) - at_limit <= LLR)
    return keep


def _linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and den * both >= num * (len(a) + len(b) - both)


def _sketch(m: int, bands: int, rows: int, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for a in range(0, batch.num_rows, 512):
                sets = X.shingle_sets(X.as_bytes(batch.column(1).slice(a, 512)), n)
                regs = registers(sets, m)
                size = np.array([len(s) for s in sets], np.int64)
                with np.errstate(over="ignore"):
                    f1 = np.array([np.sum(X.mix(s), dtype=np.uint64) for s in sets], np.uint64)
                    f2 = np.array([np.sum(X.mix(s ^ np.uint64(0xABCDEF)) * s, dtype=np.uint64) for s in sets], np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, len(sets)), pa.array(size), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)),
                     pa.array([r.tobytes() for r in regs], pa.binary()),
                     X.list_column(band_keys(regs, bands, rows))],
                    ["doc_id", "n_shingles", "f1", "f2", "regs", "bands"])
    return run


def _sets(n: int):
    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for a in range(0, batch.num_rows, 512):
                sets = X.shingle_sets(X.as_bytes(batch.column(1).slice(a, 512)), n)
                yield pa.RecordBatch.from_arrays([ids.slice(a, len(sets)), X.list_column(sets)], ["rep", "shingles"])
    return run


def _plausible(threshold: float):
    """Keep the candidate pairs (a, b) whose registers allow the threshold."""
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            t = batch.to_pydict()
            ra, rb = (np.frombuffer(b"".join(t[c]), np.uint16).reshape(len(t[c]), -1) for c in ("regs_a", "regs_b"))
            keep = may_reach(ra, rb, t["n_a"], t["n_b"], threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))
    return run


class _Block:
    """Members of one pair of blocks of one bucket, in order of size; yields the pairs worth a check."""

    def __init__(self, key, group: pd.DataFrame, threshold: float, bands: int, rows: int):
        bucket, low, high = (int(k) for k in key)
        self.group = group = group.sort_values(["n_shingles", "rep"], kind="stable", ignore_index=True)
        self.threshold, self.within = threshold, low == high
        self.comp, self.block = group["comp"].to_numpy().copy(), group["block"].to_numpy()
        self.size = group["n_shingles"].to_numpy()
        self.regs = np.frombuffer(b"".join(group["regs"]), np.uint16).reshape(len(group), bands * rows)
        self.keys = band_keys(self.regs, bands, rows).view(np.int64)
        self.mine = int((self.keys == bucket).sum(0).argmax())

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Chunks of pairs (i, k), k the larger member, of different components that may be linked.

        Each pair is handled by the first band in which it agrees. The registers are compared for
        many pairs at once: a call per member would cost more than its comparisons."""
        ends = np.searchsorted(self.size, self.size / self.threshold * (1 + 1e-9), "right")
        at, n = 0, len(self.size)
        while at < n - 1:
            left, right, count = [], [], 0
            while at < n - 1 and count < PAIRS:
                k = np.arange(at + 1, ends[at])
                k = k[self.comp[k] != self.comp[at]]
                if not self.within:
                    k = k[self.block[k] != self.block[at]]
                left.append(np.full(len(k), at))
                right.append(k)
                count += len(k)
                at += 1
            i, k = np.concatenate(left), np.concatenate(right)
            for x in range(0, len(i), PAIRS):
                yield self._plausible(i[x:x + PAIRS], k[x:x + PAIRS])

    def _plausible(self, i: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        new = ~(self.keys[i, :self.mine] == self.keys[k, :self.mine]).any(1)
        i, k = i[new], k[new]
        if len(i):
            keep = may_reach(self.regs[i], self.regs[k], self.size[i], self.size[k], self.threshold)
            i, k = i[keep], k[keep]
        return i, k


def _block_rows(threshold: float, bands: int, rows: int):
    """The members of a pair of blocks that have a partner worth a check."""
    def run(key, group: pd.DataFrame) -> pd.DataFrame:
        b = _Block(key, group, threshold, bands, rows)
        hit = np.zeros(len(group), bool)
        for i, k in b.pairs():
            hit[i] = True
            hit[k] = True
        return b.group[hit]
    return run


def _block_links(num: int, den: int, bands: int, rows: int):
    """Confirmed links between different components inside one pair of blocks of one bucket."""
    def run(key, group: pd.DataFrame) -> pd.DataFrame:
        b = _Block(key, group, num / den, bands, rows)
        reps, comp = b.group["rep"].to_numpy(), b.comp
        sets = [np.asarray(s, np.int64).view(np.uint64) for s in b.group["shingles"]]
        out = []
        for chunk in b.pairs():
            for i, k in zip(*chunk):
                if comp[k] != comp[i] and _linked(sets[i], sets[k], num, den):
                    out.append((reps[i], reps[k]))
                    comp[comp == comp[k]] = comp[i]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")
    return run


def near_duplicates(docs: DataFrame, num: int = 85, den: int = 100, shingle: int = 5, rows: int = 5,
                    miss: float = 1e-6, block: int = 1024, block_bytes: int = 32 << 20) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of ``docs`` (doc_id, text; others ignored).

    Two documents are linked if den * |A and B| >= num * |A or B| on their full shingle sets.
    component_id is the smallest doc_id reachable over links; kept = (doc_id is component_id).
    Defined cases: null or empty text has no shingles and is linked with nothing; fewer than
    ``shingle`` words are one shingle; rows with a null doc_id are linked with nothing, kept, and
    have a null component_id; rows sharing a doc_id share a component and all get its answer; an empty
    table gives an empty result; a text of any length counts whole. A block holds about ``block``
    members and ``block_bytes`` of shingles, or a single longer document.
    """
    bands = bands_for(num / den, rows, miss)
    m = bands * rows
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches = stored(docs.mapInArrow(
        _sketch(m, bands, rows, shingle),
        "doc_id long, n_shingles long, f1 long, f2 long, regs binary, bands array<long>"), "sketches")

    full = sketches.filter("n_shingles > 0 and doc_id is not null")
    cls = ["f1", "f2", "n_shingles"]
    firsts = full.groupBy(*cls).agg(F.min("doc_id").alias("rep"))
    same = (full.select("doc_id", *cls).join(firsts, cls).filter("doc_id != rep")
            .select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    reps = stored(full.join(firsts.withColumnRenamed("rep", "doc_id"), [*cls, "doc_id"], "left_semi")
                  .select("doc_id", "n_shingles", "regs", "bands"), "reps")

    keyed = reps.select(F.col("doc_id").alias("rep"), F.explode("bands").alias("key"))
    buckets = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("hub")).filter("n > 1")
    members = stored(keyed.join(buckets, "key"), "members")

    ids = members.select("rep").distinct()
    # a merge join at every size: the text is shuffled once, whatever the number of ids
    sets = stored(docs.join(ids.hint("merge"), docs.doc_id == ids.rep, "left_semi").mapInArrow(
        _sets(shingle), "rep long, shingles array<long>"), "sets")

    regs = reps.select("doc_id", "regs", "n_shingles")
    stars = (members.filter("rep != hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct()
             .join(regs.toDF("a", "regs_a", "n_a"), "a").join(regs.toDF("b", "regs_b", "n_b"), "b"))
    stars = stars.mapInArrow(_plausible(num / den), "a long, b long")
    both = F.size(F.array_intersect("sa", "sb"))
    stars = (stars.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
             .filter((both > 0) & (den * both >= num * (F.size("sa") + F.size("sb") - both))).select("a", "b"))
    links = stored(same.union(stars), "links")
    comps = stored(components(links), "comps")

    sized = reps.select(F.col("doc_id").alias("rep"), "n_shingles")
    rest = (members.filter("rep != hub").select("key", "rep").join(comps.toDF("rep", "comp"), "rep", "left")
            .withColumn("comp", F.coalesce("comp", "rep")).join(sized, "rep"))
    open_ = (rest.groupBy("key").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("total"),
                                     F.min("comp").alias("lo"), F.max("comp").alias("hi"))
             .filter("lo != hi").select("key", F.greatest(F.ceil(F.col("n") / F.lit(block)), F.ceil(
                 F.col("total") * 8 / F.lit(block_bytes))).cast("int").alias("blocks")))
    rest = rest.select("key", "rep", "comp", "n_shingles").join(open_, "key")
    rest = rest.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    # every pair of blocks of a bucket is one task group; a bucket of one block is just itself
    rest = rest.join(reps.select(F.col("doc_id").alias("rep"), "regs"), "rep")
    rest = rest.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select(
        "key", "rep", "comp", "n_shingles", "regs", "block", F.least("block", "other").alias("low"),
        F.greatest("block", "other").alias("high"))
    worth = stored(rest.groupBy("key", "low", "high").applyInPandas(
        _block_rows(num / den, bands, rows), rest.schema), "worth")
    more = (worth.join(sets, "rep").groupBy("key", "low", "high")
            .applyInPandas(_block_links(num, den, bands, rows), "a long, b long"))
    more = stored(more, "links2")
    if more.isEmpty():
        final = comps
    else:
        final = components(comps.toDF("a", "b").union(more))
    return (sketches.select("doc_id", "n_shingles").join(final.toDF("doc_id", "component_id"), "doc_id", "left")
            .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))
