"""Quality by importance resampling over hashed n-gram generative models.

Two bag-of-n-gram models, target (labelled good text) and raw (the whole corpus), over a fixed number
of hash buckets. A document's log importance weight is the sum over its n-grams of
log p_target - log p_raw. N-grams are taken from two views of the token stream, each with its own
buckets: surface tokens (1- and 2-grams) and token shapes (1-, 2- and 3-grams of kind, case, length
class and "repeats one of the last three words"), so that unseen words still carry evidence.

Resampling keeps k documents by Gumbel top-k on keys ``sharpness * weight per n-gram + Gumbel noise``,
which draws without replacement in proportion to exp(sharpness * weight). The noise comes from a seeded
hash of the doc_id, so a rerun draws the same sample. k is a parameter; by default it is the number of
documents at or above a cut that is fitted on labelled rows (see ``fit``). The default sharpness draws
among documents within a few tenths of the cut and leaves those far from it alone, as a filter of a
corpus should; a sharpness of order 1 with a given k resamples the whole corpus.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveil.llm import text as X
from surveil.llm.selection import kth_largest
from surveil.session import stored

SURFACE = 1 << 14        # buckets of the surface view
SHAPE = 1 << 12          # buckets of the shape view
SMOOTH = 1.0             # added to every bucket
LABELLED = 20_000        # most labelled rows used to fit (broadcast: 20 000 x 16 bytes)
SHARPNESS = 20.0         # weight per n-gram -> Gumbel location: a document 0.15 below the cut is drawn with odds of e**-3

_KIND = np.full(256, 2, np.uint8)                      # other bytes: punctuation
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _KIND[_a:_b] = 1
_KIND[list(X.SEPARATORS)] = 0
_UPPER, _LOWER, _DIGIT = (np.zeros(256, np.int32) for _ in range(3))
_UPPER[65:91] = 1
_LOWER[97:123] = 1
_DIGIT[48:58] = 1


def _tokens(buf: np.ndarray) -> tuple[np.ndarray, ...]:
    """(start, hash, kind, size, case) of the tokens of a byte buffer: runs of one kind, punctuation apart from words."""
    kind = _KIND[buf]
    cut = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    starts = np.concatenate([[0], cut])
    ends = np.concatenate([cut, [len(buf)]])
    k = kind[starts]
    starts, ends, k = starts[k > 0], ends[k > 0], k[k > 0]
    size = ends - starts
    if not len(starts):
        return starts, np.empty(0, np.uint64), k, size, size
    body = buf[kind > 0]
    first = np.cumsum(size) - size
    pos = np.arange(len(body)) - np.repeat(first, size)
    h = X.mix(np.add.reduceat(X._BYTE[body] * X._R[pos & 0xFFFF], first) + size.astype(np.uint64))
    up, low, dig = (np.add.reduceat(t[body], first) for t in (_UPPER, _LOWER, _DIGIT))
    case = np.where(dig > 0, 3, np.where((up >= 2) & (low == 0), 2, np.where(up > 0, 1, 0)))
    return starts, h, k, size, case


def _shapes(h: np.ndarray, k: np.ndarray, size: np.ndarray, case: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Shape of each token; a word's repetition is looked up among the last three words of its own document."""
    again = np.zeros(len(h), bool)
    words = np.flatnonzero(k == 1)
    w, d = h[words], doc[words]
    for lag in (1, 2, 3):
        again[words[lag:]] |= (w[lag:] == w[:-lag]) & (d[lag:] == d[:-lag])
    shape = np.where(k == 2, 64 + np.minimum(size, 8) + (h % np.uint64(32)).astype(np.int64) * 16,
                     case * 8 + np.minimum(size // 4, 3) + 4 * again)
    return shape.astype(np.uint64) + np.uint64(1)


def _buckets(h: np.ndarray, shape: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, document) of every n-gram of every view; n-grams never cross documents."""
    out, of = [], []
    for values, orders, base, size in ((h, (1, 2), 0, SURFACE), (shape, (1, 2, 3), SURFACE, SHAPE)):
        for n in orders:
            g = X.gram_hashes(values, n)
            if len(g):
                ok = doc[:len(g)] == doc[n - 1:]
                out.append(base + (g[ok] % np.uint64(size)).astype(np.int64))
                of.append(doc[:len(g)][ok])
    return (np.concatenate(out), np.concatenate(of)) if out else (np.empty(0, np.int64), np.empty(0, np.int64))


def ngrams(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Batches of (bucket, index of the text). A long text's bytes are read in pieces cut between words, its tokens
    are then put together: no n-gram is lost, and none depends on the other texts of a batch."""
    short: list[tuple[int, bytes]] = []
    size = 0
    for i, t in enumerate(texts):
        if len(t) > X.CHUNK:
            parts = [_tokens(np.frombuffer(p, np.uint8))[1:] for group in X._pieces([t]) for _, p in group]
            h, k, n, case = (np.concatenate(c) for c in zip(*parts))
            doc = np.full(len(h), i, np.int64)
            yield _buckets(h, _shapes(h, k, n, case, doc), doc)
            continue
        short.append((i, t))
        size += len(t)
        if size >= X.CHUNK:
            yield _short_ngrams(short)
            short, size = [], 0
    if short:
        yield _short_ngrams(short)


def _short_ngrams(group: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    buf = np.frombuffer(b" ".join(p for _, p in group) + b" ", np.uint8)
    at = np.cumsum([0] + [len(p) + 1 for _, p in group])
    starts, h, k, size, case = _tokens(buf)
    doc = np.array([i for i, _ in group], np.int64)[np.searchsorted(at, starts, side="right") - 1]
    return _buckets(h, _shapes(h, k, size, case, doc), doc)


def histogram(texts: list[bytes]) -> np.ndarray:
    """n-gram counts per bucket over all texts."""
    total = np.zeros(SURFACE + SHAPE, np.int64)
    for bucket, _ in ngrams(texts):
        total += np.bincount(bucket, minlength=len(total))
    return total


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """log p_target - log p_raw per bucket, each view normalised on its own; zeros if a side is empty."""
    out = np.zeros(SURFACE + SHAPE)
    for a, b in ((0, SURFACE), (SURFACE, SURFACE + SHAPE)):
        t, r = target[a:b] + SMOOTH, raw[a:b] + SMOOTH
        if target[a:b].sum() and raw[a:b].sum():
            out[a:b] = np.log(t / t.sum()) - np.log(r / r.sum())
    return out


def weights(texts: list[bytes], ratio: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log importance weight, n-grams) of each text."""
    total, count = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    for bucket, doc in ngrams(texts):
        total += np.bincount(doc, ratio[bucket], len(texts))
        count += np.bincount(doc, minlength=len(texts))
    return total, count


def best_cut(score: np.ndarray, good: np.ndarray) -> float:
    """Cut on the mean weight with the best balanced accuracy on labelled rows; halfway between neighbours."""
    if not len(score) or good.all() or not good.any():
        return -math.inf
    order = np.argsort(score, kind="stable")
    s, g = score[order], good[order]
    kept_good = 1 - np.concatenate([[0], np.cumsum(g)]) / g.sum()
    gone_bad = np.concatenate([[0], np.cumsum(~g)]) / (~g).sum()
    i = int(np.argmax(kept_good + gone_bad))
    if i == 0:
        return -math.inf
    return float((s[i - 1] + s[min(i, len(s) - 1)]) / 2)


class Model:
    """Log ratio per bucket, cut on the mean weight, and the seed and sharpness of the Gumbel draw."""

    def __init__(self, ratio: np.ndarray, cut: float, seed: int = 0, sharpness: float = SHARPNESS):
        self.ratio, self.cut, self.seed, self.sharpness = ratio, cut, seed, sharpness

    def scorer(self):
        """Arrow UDF (text, hash of the doc_id) -> struct<n, weight, score, key>.

        ``score`` is the weight per n-gram; ``key`` adds the Gumbel noise. A text without n-grams
        (null, empty, only separators) has a null score and key."""
        ratio, sharpness = self.ratio.astype(np.float32), self.sharpness

        @F.arrow_udf("struct<n:bigint,weight:double,score:double,key:double>")
        def score(text: pa.Array, noise: pa.Array) -> pa.Array:
            parts = [weights(X.as_bytes(text.slice(i, 512)), ratio) for i in range(0, len(text), 512)]
            w, n = (np.concatenate(c) for c in zip(*parts)) if parts else (np.empty(0), np.empty(0, np.int64))
            u = ((noise.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) >> np.uint64(11)) + 0.5) / 2.0**53
            mean = w / np.maximum(n, 1)
            none = n == 0
            return pa.StructArray.from_arrays(
                [pa.array(n), pa.array(w), pa.array(mean, mask=none), pa.array(sharpness * mean - np.log(-np.log(u)), mask=none)],
                ["n", "weight", "score", "key"])
        return score

    def column(self, docs: DataFrame):
        """``scorer`` applied to the rows of ``docs``."""
        return self.scorer()(docs["text"], F.xxhash64(docs["doc_id"], F.lit(self.seed)))


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One histogram per task: (bucket, raw count, target count)."""
    raw, target = np.zeros(SURFACE + SHAPE, np.int64), np.zeros(SURFACE + SHAPE, np.int64)
    for batch in batches:
        for i in range(0, batch.num_rows, 512):
            texts, good = X.as_bytes(batch.column(0).slice(i, 512)), batch.column(1).slice(i, 512).to_pylist()
            rest = histogram([t for t, g in zip(texts, good) if not g])
            mine = histogram([t for t, g in zip(texts, good) if g])
            raw += rest + mine
            target += mine
    used = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(raw[used]), pa.array(target[used])], ["bucket", "raw", "target"])


def fit(docs: DataFrame, labels: DataFrame, seed: int = 0, labelled: int = LABELLED, sharpness: float = SHARPNESS) -> Model:
    """Raw counts over every row of ``docs``; target counts and the cut from at most ``labelled``
    labelled documents (the first by a seeded hash of doc_id; quality 1 is the target).

    A doc_id labelled more than once counts as good only if all its labels are 1. Without both
    kinds of labels the cut is minus infinity: nothing is rejected."""
    lab = (labels.filter("doc_id is not null and quality is not null").groupBy("doc_id")
           .agg((F.min("quality") == 1).alias("good")).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(labelled))
    lab = stored(lab, "labelled")
    text = docs.select("doc_id", "text")
    marked = text.join(F.broadcast(lab), "doc_id", "left")          # at most ``labelled`` rows
    counts = (marked.select("text", F.coalesce("good", F.lit(False)).alias("good"))
              .mapInArrow(_partial, "bucket long, raw long, target long")
              .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas())
    raw, target = np.zeros(SURFACE + SHAPE), np.zeros(SURFACE + SHAPE)
    raw[counts["bucket"]], target[counts["bucket"]] = counts["raw"], counts["target"]
    model = Model(log_ratio(target, raw), -math.inf, seed, sharpness)
    sample = text.join(F.broadcast(lab), "doc_id")
    # no filter on the score here: it would be pushed below the join and score every document
    scored = (sample.select("doc_id", "good", model.column(sample).alias("s"))
              .groupBy("doc_id").agg(F.avg("s.score").alias("score"), F.max("good").alias("good")).toPandas().dropna(subset=["score"]))
    model.cut = best_cut(scored["score"].to_numpy(float), scored["good"].to_numpy(bool))
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_ngrams, log_weight, score, key) for each row of ``docs``; one narrow pass."""
    return docs.select("doc_id", model.column(docs).alias("s")).select(
        "doc_id", F.col("s.n").alias("n_ngrams"), F.col("s.weight").alias("log_weight"),
        F.col("s.score").alias("score"), F.col("s.key").alias("key"))


def threshold(scores: DataFrame, model: Model, k: int | None = None) -> float:
    """Key of the last document that Gumbel top-k keeps; by default k = documents scoring at or above the cut."""
    if k is None:
        k = scores.filter(F.col("score") >= model.cut).count()
    if not k:
        return math.inf
    last = kth_largest(scores, "key", k)
    return -math.inf if last is None else last          # fewer documents than k: all of them


def resample(docs: DataFrame, labels: DataFrame, seed: int = 0, k: int | None = None, sharpness: float = SHARPNESS) -> DataFrame:
    """``scored`` plus ``kept``. Rows with a null score are not kept; ties at the last key all are.

    Only doc_id and text are read, so other columns may have any name. Null doc_ids draw the noise
    of a null and are never labelled. Texts of any length are read whole, and a document's score and key depend
    on nothing but its text, its doc_id and the model. An empty table gives an empty result."""
    model = fit(docs, labels, seed, sharpness=sharpness)
    scores = stored(scored(docs, model), "scores")
    last = threshold(scores, model, k)
    return scores.withColumn("kept", F.coalesce(F.col("key") >= F.lit(last), F.lit(False)))


def keep(docs: DataFrame, labels: DataFrame, seed: int = 0) -> DataFrame:
    """Rows of ``docs`` that ``resample`` keeps, all columns; keys are recomputed, not joined."""
    model = fit(docs, labels, seed)
    last = threshold(stored(scored(docs, model), "scores"), model)
    return docs.filter(model.column(docs)["key"] >= F.lit(last))
