"""Exact top-k by inner product with M-trees: paged metric nodes, best-first search.

Rows are dealt to the nearest of a bounded sample of routing vectors, and each routing cell is split
by a hash into blocks of about ``block`` rows (a cell of equal vectors as well). A small table keeps
each block's largest norm and largest angle to its routing vector. Every query first searches the
blocks of its own cell, which gives it a k-th score; then it is sent only to the other blocks whose
cone and norm leave room for a better one. A task group is one data block and one block of queries, so
no task holds more than two blocks, queries are never broadcast, and a block's tree is built once per
block of queries. Inside a group an M-tree is bulk-loaded over the block: inner nodes keep routing
vectors, covering radii and distances to the parent's routing vector, leaf pages keep their rows and
distances to the page's routing vector.

For a query q and a ball with centre c and radius r, <q, x> <= <q, c> + |q| r. With the stored
distance d(c, p) to the parent and the known <q, p>, <q, c> <= <q, p> + |q| d(c, p) bounds a
child, or a single row of a leaf, without touching its vector. Nodes are visited in the order of
their bounds until none can beat the k-th score, the one from the query's own cell included; scores are
exact integers. Groups return their k best per query, which are merged by one grouped selection.

Where vectors have no neighbourhoods (random directions in many dimensions) the bounds cannot cut,
and nearly every vector is compared: the tree then costs its building, the pages keep the rest vectorised.
"""

from __future__ import annotations

import heapq
import math
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveil.llm.blocks import CELLS, deal, integer_vectors, search, stack, unit
from surveil.session import stored

PAGE = 256               # rows of a leaf page
FAN = 8                  # children of an inner node
PIVOTS = 64              # routing vectors sampled to deal rows into cells
SLACK = 1e-6             # relative float slack of the bounds


class Tree:
    """M-tree over the rows of one block."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.v = ids, vectors
        self.f = vectors.astype(np.float64)
        self.computed = 0                                   # inner products taken, for tests
        self.root = self._build(np.arange(len(ids)), None)

    def _build(self, rows: np.ndarray, parent: np.ndarray | None) -> dict:
        x = self.f[rows]
        centre = x[int(((x - x.mean(0)) ** 2).sum(1).argmin())]       # routing object: a row near the mean
        dist = np.sqrt(((x - centre) ** 2).sum(1))
        node = {"c": centre, "r": float(dist.max()), "up": 0.0 if parent is None else float(np.sqrt(((centre - parent) ** 2).sum()))}
        if len(rows) <= PAGE or node["r"] == 0.0:
            order = np.argsort(dist, kind="stable")
            return node | {"rows": rows[order], "d": dist[order]}
        seeds = [int(dist.argmax())]                                   # far-apart seeds
        near = np.sqrt(((x - x[seeds[0]]) ** 2).sum(1))
        cell = np.zeros(len(rows), np.int64)
        for k in range(1, FAN):
            s = int(near.argmax())
            if near[s] == 0.0:
                break
            d = np.sqrt(((x - x[s]) ** 2).sum(1))
            cell[d < near] = k
            near = np.minimum(near, d)
            seeds.append(s)
        parts = [rows[cell == k] for k in range(len(seeds))]
        return node | {"kids": [self._build(p, centre) for p in parts if len(p)]}

    def search(self, q: np.ndarray, own: int, k: int, need: float = -math.inf) -> list[tuple[int, int]]:
        """The k best (score, id), ties to smaller ids, without the row of id ``own``; scores below ``need`` are not looked for."""
        qf = q.astype(np.float64)
        length = math.sqrt(float(qf @ qf))
        best: list[tuple[int, int]] = []                               # heap of (score, -id)
        tick = count()
        top = float(qf @ self.root["c"])
        heap = [(-(top + length * self.root["r"]), next(tick), self.root, top)]
        while heap:
            bound, _, node, at = heapq.heappop(heap)
            floor_ = max(best[0][0], need) if len(best) == k else need
            if -bound + SLACK * (1 + abs(bound)) < floor_:
                break
            if "rows" in node:
                may = at + length * node["d"]
                rows = node["rows"][may + SLACK * (1 + np.abs(may)) >= floor_]
                self.computed += len(rows)
                scores, ids = self.v[rows] @ q, self.ids[rows]
                keep = scores >= floor_
                scores, ids = scores[keep], ids[keep]
                order = np.lexsort((ids, -scores))
                taken = 0
                for i in order:
                    if ids[i] == own:
                        continue
                    item = (int(scores[i]), -int(ids[i]))
                    if len(best) < k:
                        heapq.heappush(best, item)
                    elif item > best[0]:
                        heapq.heapreplace(best, item)
                    taken += 1
                    if taken == k:
                        break
                continue
            for kid in node["kids"]:
                may = at + length * (kid["up"] + kid["r"])             # parent distance: no product needed
                if may + SLACK * (1 + abs(may)) < floor_:
                    continue
                self.computed += 1
                mid = float(qf @ kid["c"])
                heapq.heappush(heap, (-(mid + length * kid["r"]), next(tick), kid, mid))
        return [(s, -i) for s, i in sorted(best, reverse=True)]


def _search_block(k: int):
    def run(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(queries):
            dim = int(rows["dim"].iloc[0])
            rows = rows.sort_values("vec_id")
            tree = Tree(rows["vec_id"].to_numpy(np.int64), stack(rows["v"], dim))
            for own, q, need in zip(queries["vec_id"], stack(queries["v"], dim), queries["need"]):
                out += [(own, i, s) for s, i in tree.search(q, own, k, need)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"], dtype="int64")
    return run


def top_k(rows: DataFrame, is_query: Column, k: int = 5, block: int = 4096, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``is_query`` picks, the k best other rows.

    Score: inner product of the integer vectors; ties to the smaller id. Rows with a null id, or a
    vector that is null, empty or holds null or non-finite components take no part, neither as
    queries nor as candidates. Repeated rows count once; if an id has several vectors the
    smallest (length, bytes of the integers) stands for it. Vectors are compared with vectors of the same length only.
    A query without candidates gives no rows; an empty table gives an empty result.
    """
    v = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.lit(0).cast("long").alias("label"), F.coalesce(is_query, F.lit(False)).alias("anchor"),
                    F.col(vector).cast("array<double>").alias("v")).mapInArrow(integer_vectors, "vec_id long, label long, anchor boolean, dim int, v binary")
    v = v.filter("dim > 0").groupBy("vec_id").agg(F.min(F.struct("dim", "v")).alias("s"), F.max("anchor").alias("anchor")).select(
        "vec_id", F.lit(0).cast("long").alias("label"), "anchor", "s.dim", "s.v")
    v = stored(v, "vectors")
    pivots: dict[int, list[bytes]] = {}
    for r in v.filter("anchor").orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOTS).select("dim", "v").collect():
        pivots.setdefault(r.dim, []).append(bytes(r.v))
    cells = stored(v.mapInArrow(deal({dim: unit(stack(p, dim))[0] for dim, p in pivots.items()}), CELLS), "cells")
    blocks = cells.groupBy("dim", "cell").agg(F.ceil(F.count("*") / F.lit(block)).alias("blocks"))
    dealt = cells.join(blocks, ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("blocks"))).drop("blocks")
    known = stored(dealt.groupBy("dim", "cell", "part").agg(F.max("norm").alias("longest"), F.max("angle").alias("widest")), "blocks")
    asks = cells.filter("anchor")
    n = asks.groupBy("dim").agg(F.ceil(F.count("*") / F.lit(block)).alias("asks"))
    asks = asks.join(n, "dim").withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("asks"))).drop("asks")
    kind = "query_id long, vec_id long, score long"
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def top(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    nothing = F.lit(float("-inf"))
    near = stored(top(search(dealt, known, asks.withColumn("need", nothing), _search_block(k), kind, ["need"], True)), "near")
    least = near.groupBy(F.col("query_id").alias("vec_id")).agg(F.count("*").alias("n"), F.min("score").alias("least"))
    needs = asks.join(least, "vec_id", "left").withColumn("need", F.when(F.col("n") >= k, F.col("least").cast("double")).otherwise(nothing)).drop("n", "least")
    far = search(dealt, known, needs, _search_block(k), kind, ["need"], False)
    return top(near.drop("rank").unionByName(far)).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
