"""Hard negatives by shared lists: one sorted candidate list per cluster of anchors (MAXIMUS style).

Rows are dealt to the nearest (by angle) of a bounded sample of routing vectors and every routing cell is
split by a hash into shards of about ``shard`` rows, so a cell of equal vectors is split as well. Anchors
of one routing cell form a cluster. A task holds one shard and a block of anchors. For each cluster in it
the shard is sorted once by the angular upper bound |x| cos(max(0, angle(x, centre) - cone)), ``cone`` being
the largest angle between a member and the cluster's centre: no member q scores more than |q| times it.
Every member walks that one list, in blocks of one matrix product for all members still walking, until the
bound of what is left is below what it still needs; then its result is certified.

Whole shards are left out the same way: |q| times the shard's largest norm times the cosine of the least
possible angle must reach what the anchor needs, which its own cell's shards tell first.

Positives come first. Their scores give the window of each (anchor, positive) for the second walk.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveil.llm.blocks import CELLS, SLACK, angles_between, deal, integer_vectors, search, stack, unit
from surveil.session import stored

PIVOTS = 64              # routing vectors, sampled from the anchors
SHARD = 4096             # rows of a shard
BLOCK = 4096             # anchors of a block
STEP = 512               # rows of a list walked at a time


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Type in which the inner products of rows of a and b are exact (beyond 64 bits: doubles, rounded)."""
    most = float(a.shape[1]) * max(1.0, float(np.abs(a).max(initial=0))) * max(1.0, float(np.abs(b).max(initial=0)))
    return np.float64 if most < 2.0**53 or most >= 2.0**63 else np.int64


class Best:
    """The k best (score, id) of each ask, ties to smaller ids; fed with hits in any order."""

    def __init__(self, asks: int, k: int, kind):
        self.k = k
        self.low = -np.inf if kind == np.float64 else np.iinfo(np.int64).min
        self.score = np.full((asks, k), self.low, kind)
        self.id = np.full((asks, k), np.iinfo(np.int64).max)

    def add(self, ask: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        if not len(ask):
            return
        some = np.unique(ask)
        ask = np.concatenate([ask, np.repeat(some, self.k)])
        score = np.concatenate([score, self.score[some].ravel()])
        ident = np.concatenate([ident, self.id[some].ravel()])
        order = np.lexsort((ident, -score if score.dtype == np.float64 else ~score, ask))
        ask, score, ident = ask[order], score[order], ident[order]
        rank = np.arange(len(ask)) - np.searchsorted(ask, ask)
        top = rank < self.k
        self.score[ask[top], rank[top]] = score[top]
        self.id[ask[top], rank[top]] = ident[top]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ask, id, score) of what was found."""
        ask, rank = np.nonzero(self.id != np.iinfo(np.int64).max)
        return ask, self.id[ask, rank], np.clip(self.score[ask, rank], -2.0**63, 2.0**63 - 1024).astype(np.int64) \
            if self.score.dtype == np.float64 else self.score[ask, rank]


def _walk(rows: pd.DataFrame, asks: pd.DataFrame, dim: int, wanted: Callable, step: int, seen: list | None = None) -> None:
    """Walks the shard's list once for each cluster of anchors. ``wanted(members)`` gives (need, take): ``need()`` is
    the score each member still needs, ``take(active, block, scores)`` takes the scores of the active members."""
    x, q = stack(rows["v"], dim), stack(asks["v"], dim)
    way, norm = unit(x)
    mine, length = unit(q)
    kind = _exact(x, q)
    x, q = x.astype(kind), q.astype(kind)
    cells = asks["cell"].to_numpy()
    for cell in np.unique(cells):
        members = np.flatnonzero(cells == cell)
        centre = mine[members].sum(0)
        centre = (centre / (np.sqrt((centre * centre).sum()) or 1))[None]
        cone = angles_between(mine[members], centre).max()
        bound = norm * np.cos(np.maximum(0.0, angles_between(way, centre)[:, 0] - cone))     # once for all members
        order = np.argsort(-bound, kind="stable")
        bound = bound[order]
        slack = SLACK * (1 + length[members] * norm.max(initial=0.0))
        need, take = wanted(members)
        for a in range(0, len(order), step):
            active = np.flatnonzero(length[members] * bound[a] + slack >= need())
            if not len(active):
                break
            block = order[a:a + step]
            if seen is not None:
                seen.append((len(active), len(block)))
            take(active, block, q[members[active]] @ x[block].T)


def _best_of_block(scores: np.ndarray, ok: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the scores that may be among the k best of a line and reach its floor."""
    masked = np.where(ok, scores, -np.inf if scores.dtype == np.float64 else np.iinfo(np.int64).min)
    if masked.shape[1] > k:
        floor = np.maximum(floor, np.partition(masked, masked.shape[1] - k, axis=1)[:, -k])
    return np.nonzero(ok & (masked >= floor[:, None]))


def _positives(k: int, step: int):
    """(anchor_id, vec_id, score): per shard the k best other rows of the anchor's label."""
    def run(rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(asks):
            return pd.DataFrame(columns=["anchor_id", "vec_id", "score"], dtype="int64")
        ids, labels = rows["vec_id"].to_numpy(), rows["label"].to_numpy()
        own, label, dim = asks["vec_id"].to_numpy(), asks["label"].to_numpy(), int(rows["dim"].iloc[0])
        kind = _exact(stack(rows["v"], dim), stack(asks["v"], dim))
        best = Best(len(asks), k, kind)
        told = asks["need"].to_numpy()

        def wanted(members):
            def need():
                return np.maximum(told[members], best.score[members, -1])

            def take(active, block, scores):
                m = members[active]
                ok = (labels[block][None] == label[m][:, None]) & (ids[block][None] != own[m][:, None])
                r, c = _best_of_block(scores, ok, best.score[m, -1], k)
                best.add(m[r], scores[r, c], ids[block[c]])
            return need, take
        _walk(rows, asks, dim, wanted, step)
        ask, ident, score = best.rows()
        return pd.DataFrame({"anchor_id": own[ask], "vec_id": ident, "score": score})
    return run


def _negatives(k: int, low: int, step: int):
    """(anchor_id, positive, vec_id, score): per shard the k best rows of other labels in each positive's window."""
    def run(rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(asks):
            return pd.DataFrame(columns=["anchor_id", "positive", "vec_id", "score"], dtype="int64")
        ids, labels = rows["vec_id"].to_numpy(), rows["label"].to_numpy()
        own, label, dim = asks["vec_id"].to_numpy(), asks["label"].to_numpy(), int(rows["dim"].iloc[0])
        kind = _exact(stack(rows["v"], dim), stack(asks["v"], dim))
        most = asks["high"].map(len).max()
        high = np.stack([np.pad(np.asarray(h, np.int64), (0, most - len(h)), constant_values=-1) for h in asks["high"]])
        least = -(-low * high // 100)                       # 100 score >= low high, in integers
        found = [Best(len(asks), k, kind) for _ in range(most)]

        def wanted(members):
            def floors(m):
                # a window of a negative score is empty: nothing is needed for it
                each = [np.where(high[m, j] >= 0, np.maximum(least[m, j], found[j].score[m, -1]).astype(np.float64), np.inf) for j in range(most)]
                return np.min(each, axis=0)

            def need():
                return floors(members)

            def take(active, block, scores):
                m = members[active]
                r, c = np.nonzero((scores >= floors(m)[:, None]) & (scores <= high[m].max(1)[:, None]) & (labels[block][None] != label[m][:, None]))
                s, g, i = scores[r, c], m[r], ids[block[c]]
                for j in range(most):
                    fits = (s <= high[g, j]) & (s >= least[g, j]) & (high[g, j] >= 0) & (s >= found[j].score[g, -1])
                    found[j].add(g[fits], s[fits], i[fits])
            return need, take
        _walk(rows, asks, dim, wanted, step)
        out = []
        for j, best in enumerate(found):
            ask, ident, score = best.rows()
            out.append(pd.DataFrame({"anchor_id": own[ask], "positive": np.full(len(ask), j + 1), "vec_id": ident, "score": score}))
        return pd.concat(out)
    return run


def mine(rows: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 5, low: int = 80,
         id_col: str = "vec_id", vector: str = "embedding", shard: int = SHARD, block: int = BLOCK, step: int = STEP) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Vectors become integers floor(256 x); a score is their inner product, ties go to the smaller id. An anchor's
    positives are its ``positives`` best other rows of the same label, a positive's negatives the ``negatives`` best
    rows of other labels with low * positive_score <= 100 * negative_score <= 100 * positive_score (none if the
    positive score is negative). Fewer rows give fewer results; an anchor without positives gives none.

    Rows with a null id, label or vector, or a null or non-finite component take no part. Vectors are compared with
    vectors of the same length only (also empty ones: every score is 0). Repeated rows count once; if an id has
    several labels or vectors, the smallest (label, vector bytes) stands for it. Other columns may have any name.
    Scores are exact up to 64 bits; components beyond 2**62 are cut to it and scores beyond the long range are
    rounded and end there. An empty table gives an empty result."""
    taken = rows.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"),
                        F.coalesce(is_anchor, F.lit(False)).alias("anchor"), F.col(vector).cast("array<double>").alias("v"))
    v = taken.mapInArrow(integer_vectors, "vec_id long, label long, anchor boolean, dim int, v binary")
    v = v.groupBy("vec_id").agg(F.min(F.struct("label", "dim", "v")).alias("s"), F.max("anchor").alias("anchor")).select(
        "vec_id", "s.label", "anchor", "s.dim", "s.v")
    v = stored(v, "vectors")
    pivots: dict[int, list[bytes]] = {}
    for r in v.filter("anchor").orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOTS).select("dim", "v").collect():
        pivots.setdefault(r.dim, []).append(bytes(r.v))
    table = {dim: unit(stack(vs, dim))[0] for dim, vs in pivots.items()}
    cells = stored(v.mapInArrow(deal(table), CELLS), "cells")
    parts = cells.groupBy("dim", "cell").agg(F.ceil(F.count("*") / F.lit(shard)).alias("parts"))
    dealt = cells.join(parts, ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts"))).drop("parts")
    shards = stored(dealt.groupBy("dim", "cell", "part").agg(F.max("norm").alias("longest"), F.max("angle").alias("widest")), "shards")
    asks = cells.filter("anchor")
    blocks = asks.groupBy("dim").agg(F.ceil(F.count("*") / F.lit(block)).alias("blocks"))
    asks = asks.join(blocks, "dim").withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("blocks"))).drop("blocks")

    kind = "anchor_id long, vec_id long, score long"
    best = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")

    def top(found: DataFrame) -> DataFrame:
        return found.withColumn("at", F.row_number().over(best)).filter(F.col("at") <= positives)
    nothing = F.lit(float("-inf"))
    near = stored(top(search(dealt, shards, asks.withColumn("need", nothing), _positives(positives, step), kind, ["need"], True)), "near")
    least = near.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.count("*").alias("n"), F.min("score").alias("least"))
    needs = asks.join(least, "vec_id", "left").withColumn("need", F.when(F.col("n") >= positives, F.col("least").cast("double")).otherwise(nothing)).drop("n", "least")
    far = search(dealt, shards, needs, _positives(positives, step), kind, ["need"], False)
    chosen = stored(top(near.drop("at").unionByName(far)), "positives")

    highs = chosen.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.array_sort(F.collect_list(F.struct("at", "score"))).alias("p"))
    highs = highs.select("vec_id", F.transform("p", lambda x: x["score"]).alias("high"))
    worst = F.array_min(F.filter("high", lambda s: s >= 0))
    wants = asks.join(highs, "vec_id").withColumn("need", low * worst.cast("double") / 100).filter("need is not null")
    found = search(dealt, shards, wants, _negatives(negatives, low, step), "anchor_id long, positive long, vec_id long, score long", ["high"])
    order = Window.partitionBy("anchor_id", "positive").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    named = chosen.select("anchor_id", F.col("at").cast("long").alias("positive"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return ranked.join(named, ["anchor_id", "positive"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
