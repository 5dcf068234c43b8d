"""Connected components of an edge table by alternating large-star and small-star steps.

Each step keeps one row per edge and replaces a vertex's neighbours by the smallest it has seen, so
work stays proportional to the edges and no component is ever gathered in one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setweave.llm.frames import written

#: Edges that a task contracts at a time.
PORTION = 1 << 20


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (vertex, smallest vertex of its component) that say the same as the edges (a, b)."""
    names, of = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = of[: len(a)], of[len(a) :]
    root = np.arange(len(names))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        while (new != new[new]).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
    moved = root != np.arange(len(names))
    return names[moved], names[root[moved]]


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the edges (a, b) that make a spanning forest of them."""
    names, of = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = of[: len(a)], of[len(a) :]
    root, edge, chosen = np.arange(len(names)), np.arange(len(a)), [np.zeros(0, np.int64)]
    while True:
        high, low = np.maximum(root[x[edge]], root[y[edge]]), np.minimum(root[x[edge]], root[y[edge]])
        live = high != low
        edge, high, low = edge[live], high[live], low[live]
        if not len(edge):
            at = np.concatenate(chosen)
            return a[at], b[at]
        high, first = np.unique(high, return_index=True)  # every root hangs itself below a smaller one, by one edge
        chosen.append(edge[first])
        root[high] = low[first]
        while (root != root[root]).any():
            root = root[root]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges (u, v) as pairs (vertex, smallest vertex of those joined to it here), PORTION edges at a time."""
    held = np.zeros((2, 0), np.int64)
    rows = lambda uv: pa.RecordBatch.from_arrays([pa.array(uv[0]), pa.array(uv[1])], names=["u", "v"])
    for b in batches:
        held = np.concatenate([held, np.stack([c.to_numpy() for c in b.columns])], 1)
        if held.shape[1] >= PORTION:
            yield rows(forest(*held))
            held = held[:, :0]
    if held.shape[1]:
        yield rows(forest(*held))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(vertex, root) for every vertex of the edges, root the smallest vertex it is joined to.

    Edges with a null end or equal ends say nothing and are left out; repeated ones count once. Vertices
    without an edge do not appear. The number of rounds grows with the logarithm of the largest component; edges that
    meet in a task are contracted there.

    The least neighbours are written before they are joined, and so is what a step leaves: the edges of a large component's
    root then come straight from a shuffle, which adaptive execution splits where they are too many for a task."""
    contracted = lambda e: written(e.where("u > v").distinct().mapInArrow(_contract, "u long, v long"), "edges")
    pairs = contracted(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")))
    while True:
        ends = pairs.select(F.col("u").alias("x"), F.lit(1).alias("low"), F.lit(0).alias("top")).unionByName(pairs.select(F.col("v").alias("x"), F.lit(0).alias("low"), F.lit(1).alias("top")))
        open_ = ends.groupBy("x").agg(F.sum("low").alias("low"), F.max("top").alias("top")).where("low > 1 or low + top > 1")  # below several, or in between
        if not open_.take(1):
            break
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = written(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct(), "large")
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        two = F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        pairs = contracted(large.join(least, "u").select(F.explode(two).alias("e")).select("e.*"))
    return pairs.select(F.col("u").alias("vertex"), F.col("v").alias("root")).unionByName(pairs.select(F.col("v").alias("vertex"), F.col("v").alias("root")).distinct())
