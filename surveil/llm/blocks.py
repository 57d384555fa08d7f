"""Vectors in blocks: integer vectors as bytes, routing cells, and which block a query must see."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLACK = 1e-6             # float slack of the bounds, times |q| |x|
CELLS = "vec_id long, label long, anchor boolean, dim int, v binary, norm double, cell int, angle double, angles array<double>"


def integer_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, label, anchor, dim, v): integer vectors as bytes, without rows that take no part."""
    for batch in batches:
        column = batch.column(3)
        ok = np.array(column.is_valid()) & np.array(batch.column(0).is_valid()) & np.array(batch.column(1).is_valid())
        keep = batch.filter(pa.array(ok))
        column = keep.column(3)
        size = np.asarray(column.value_lengths()).astype(np.int64)
        flat = column.flatten()
        x = flat.fill_null(np.nan).to_numpy(zero_copy_only=False).astype(np.float64)
        at = np.concatenate([[0], np.cumsum(size)])
        bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
        good = bad[at[1:]] == bad[at[:-1]]
        with np.errstate(invalid="ignore"):
            e = np.floor(x * 256)
        e = np.where(np.isfinite(e), np.clip(e, -2.0**62, 2.0**62), 0).astype(np.int64)
        rows = [e[a:b].tobytes() for a, b in zip(at[:-1], at[1:])]
        out = pa.RecordBatch.from_arrays([keep.column(0), keep.column(1), keep.column(2), pa.array(size.astype(np.int32)), pa.array(rows, pa.binary())],
                                         ["vec_id", "label", "anchor", "dim", "v"])
        yield out.filter(pa.array(good))


def stack(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.int64).reshape(len(column), dim)


def unit(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Directions (the zero vector's is zero) and norms."""
    f = v.astype(np.float64)
    norm = np.sqrt((f * f).sum(1))
    return f / np.where(norm > 0, norm, 1)[:, None], norm


def angles_between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


def deal(pivots: dict[int, np.ndarray]):
    """Adds norm, the nearest routing vector and its angle; for anchors, the angles to all routing vectors of their length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(3).to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                way, norm = unit(stack(part.column(4).to_pylist(), int(dim)))
                if int(dim) in pivots:
                    angles = angles_between(way, pivots[int(dim)])
                    cell = angles.argmin(1)
                else:                                      # no anchor has this length: nobody asks for these rows
                    angles, cell = np.full((len(norm), 1), np.pi), np.zeros(len(norm), np.int64)
                asks = part.column(2).to_pylist()
                own = [row.tolist() if ask else None for row, ask in zip(angles, asks)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(norm), pa.array(cell.astype(np.int32)), pa.array(angles[np.arange(len(cell)), cell]), pa.array(own, pa.list_(pa.float64()))],
                    ["vec_id", "label", "anchor", "dim", "v", "norm", "cell", "angle", "angles"])
    return run


def search(rows: DataFrame, shards: DataFrame, asks: DataFrame, function: Callable, kind: str, extra: list[str], home: bool | None = None) -> DataFrame:
    """Each block of anchors against each shard that may hold what an anchor of it needs; ``home``: in the anchors' own cell, or all others."""
    s = shards.select("dim", F.col("cell").alias("s_cell"), "part", "longest", "widest")
    angle = F.greatest(F.lit(0.0), F.get("angles", F.col("s_cell")) - F.col("widest") - F.lit(SLACK))
    reach = F.col("norm") * F.col("longest") * (F.cos(F.least(angle, F.lit(np.pi))) + F.lit(SLACK)) + F.lit(SLACK)
    pairs = asks.join(s, "dim").filter(reach >= F.col("need"))
    if home is not None:
        pairs = pairs.filter((F.col("s_cell") == F.col("cell")) == F.lit(home))
    pairs = pairs.select("dim", "s_cell", "part", "block", "vec_id", "label", "v", "cell", *extra)
    blocks = pairs.select("dim", F.col("s_cell").alias("cell"), "part", "block").distinct()
    left = rows.join(blocks, ["dim", "cell", "part"]).select("dim", "cell", "part", "block", "vec_id", "label", "v")
    # fresh column ids: both sides come from the same table
    right = pairs.select(*[F.col(c).alias(f"{c}_") for c in pairs.columns]).toDF(*pairs.columns)
    return left.groupBy("dim", "cell", "part", "block").cogroup(right.groupBy("dim", "s_cell", "part", "block")).applyInPandas(function, kind)
