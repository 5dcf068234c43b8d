"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors x and y have a cosine of at least c just if their squared distance is at most 2 - 2c. A random
rotation keeps distances and spreads them evenly over coordinates; the rotated vector is cut into blocks of few
coordinates, each with a share of that squared distance in proportion to its coordinates. If every block of a pair
exceeded its share, the pair would exceed the whole: so each pair within the distance is within the share in some
block. In every block, vectors are range-joined: they are dealt to slabs of the block's first coordinate as wide as the
share's root, and each also visits the next slab, so partners meet. Pairs within the share are verified on all coordinates
in double precision, and counted in the first of the blocks that find them.

Slabs with many vectors are cut into tiles, whose rows are compared with the rest of the slab as it streams by. Both are put
in the order of a tree over all of the block's coordinates, and only leaves whose boxes come within the share are compared.
Only counts of links and the edges of spanning forests leave a task, never its pairs.

Blocks are as wide as WIDTH: a narrow one has a small share, but more of them must be joined, and in few coordinates many pairs
are within it. Vectors without any cluster are the worst case, in which each block compares most pairs of a label.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setweave.llm.components import components, forest
from setweave.llm.frames import written

#: Coordinates of a block; vectors of a tile, which a task holds at a time, of a leaf, and of those that are compared with a
#: tile at a time; pairs that are verified at a time.
WIDTH, TILE, LEAF, STRIP, PORTION = 32, 16_384, 64, 128, 1 << 16
#: What single precision may be off by in a squared distance of unit vectors.
ROOM = np.float32(2e-5)
KEY = ["label", "dim", "block", "slab", "tile"]


@lru_cache(64)
def rotation(dim: int) -> np.ndarray:
    """A fixed random rotation."""
    q, r = np.linalg.qr(np.random.default_rng(dim).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


@lru_cache(64)
def blocks(dim: int, least: float) -> list[tuple[slice, float]]:
    """The coordinates of each block and its share of the squared distance, with room for rounding."""
    cuts = np.linspace(0, dim, max(1, round(dim / WIDTH)) + 1).round().astype(int)
    return [(slice(a, b), (2 - 2 * least) * (b - a) / dim + 1e-12) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    # by the largest component first: squares of very small or large ones neither vanish nor overflow
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _spread(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            dims = whole.column(2).to_numpy()
            for dim in np.unique(dims).tolist():
                b = whole.filter(pa.array(dims == dim))
                for k in range(0, b.num_rows, 2000):
                    part = b.slice(k, 2000)
                    turned = _unit(_matrix(part.column(4), dim)) @ rotation(dim)
                    for i, (at, share) in enumerate(blocks(dim, least)):
                        slab = np.floor(turned[:, at.start] / (np.sqrt(share) * (1 + 1e-9))).astype(np.int32)
                        for guest in (0, 1):
                            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(len(slab), i, np.int32)), pa.array(slab + guest), pa.array(np.full(len(slab), guest, np.int32))], names=[*part.schema.names, "block", "slab", "guest"])

    return run


def _order(x: np.ndarray) -> np.ndarray:
    """The rows in the order of a tree that halves them by their widest coordinate down to leaves."""
    out, stack = [], [np.arange(len(x))]
    while stack:
        rows = stack.pop()
        if len(rows) <= LEAF:
            out.append(rows)
            continue
        part = x[rows]
        half = -(-len(rows) // 2 // LEAF) * LEAF  # whole leaves
        split = np.argpartition(part[:, (part.max(0) - part.min(0)).argmax()], half)
        stack += [rows[split[half:]], rows[split[:half]]]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _boxes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest coordinates of each leaf of rows in their order."""
    at = np.arange(0, len(x), LEAF)
    return np.minimum.reduceat(x, at), np.maximum.reduceat(x, at)


class _Tile:
    """The rows of a tile, and what the rows that stream by add to them."""

    def __init__(self, dim: int, block: int, least: float):
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.dim, self.least = dim, least
        self.before = blocks(dim, least)[:block]
        self.at, self.share = blocks(dim, least)[block]
        self.ready, self.compared = None, 0

    def add(self, ids: np.ndarray, sizes: np.ndarray, x: np.ndarray) -> None:
        self.parts.append((ids, sizes, x))

    def _sorted(self, ids: np.ndarray, sizes: np.ndarray, x: np.ndarray) -> tuple:
        x = _unit(x)
        turned = x @ rotation(self.dim)
        block = turned[:, self.at].astype(np.float32)
        on = _order(block)
        return ids[on], sizes[on], x[on], turned[on], block[on]

    def close(self) -> Iterator[pa.RecordBatch]:
        if self.ready is None and self.parts:
            own = self._sorted(*[np.concatenate(c) for c in zip(*self.parts, strict=True)])
            self.parts.clear()
            self.ids, self.sizes, self.x, self.turned, self.block = own
            self.links, self.ready = np.zeros(len(self.ids), np.int64), True
            self.norm, self.low, self.high = (self.block * self.block).sum(1), *_boxes(self.block)
            yield from self._meet(*own, True)

    def stream(self, ids: np.ndarray, sizes: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        yield from self.close()
        if self.ready:
            yield from self._meet(*self._sorted(ids, sizes, x), False)

    def end(self) -> Iterator[pa.RecordBatch]:
        yield from self.close()
        if self.ready and self.links.any():
            on = self.links > 0
            yield _rows(self.ids[on], None, self.links[on])

    def _close_rows(self, strip: np.ndarray) -> np.ndarray:
        """The rows of the tile's leaves that some leaf of the strip may come near."""
        low, high = _boxes(strip)
        near = np.zeros(len(self.low), bool)
        for a, b in zip(low, high, strict=True):
            gap = np.maximum(np.maximum(self.low - b, a - self.high), 0)
            near |= (gap * gap).sum(1) <= self.share + ROOM
        return np.flatnonzero(np.repeat(near, LEAF)[: len(self.ids)])

    def _meet(self, ids, sizes, x, turned, block, own: bool) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(ids), STRIP):
            q = block[k : k + STRIP]
            rows = self._close_rows(q)
            if own:
                rows = rows[rows < k + len(q)]
            self.compared += int(np.searchsorted(rows, np.arange(k, k + len(q))).sum()) if own else len(rows) * len(q)
            near = self.norm[rows, None] + (q * q).sum(1) - 2 * (self.block[rows] @ q.T) <= self.share + ROOM
            i, j = np.nonzero(near)
            i = rows[i]
            if own:
                i, j = i[i < j + k], j[i < j + k]
            gained = np.zeros(len(q), np.int64)
            ends = []
            for p in range(0, len(i), PORTION):
                a, b = i[p : p + PORTION], j[p : p + PORTION] + k
                # the same sums in every task, so that each pair is counted in one block
                gap = (self.turned[a] - turned[b]) ** 2
                good = gap[:, self.at].sum(1) <= self.share
                for at, share in self.before:
                    good &= gap[:, at].sum(1) > share
                a, b = a[good], b[good]
                good = (self.x[a] * x[b]).sum(1) >= self.least
                a, b = a[good], b[good]
                np.add.at(self.links, a, sizes[b])
                if own:
                    np.add.at(self.links, b, sizes[a])
                else:
                    np.add.at(gained, b - k, self.sizes[a])
                if len(a):
                    ends.append(forest(self.ids[a], ids[b]))
            if ends:
                yield _rows(*forest(*[np.concatenate(e) for e in zip(*ends, strict=True)]), None)
            if gained.any():
                on = gained > 0
                yield _rows(ids[k : k + STRIP][on], None, gained[on])


def _rows(a: np.ndarray, b: np.ndarray | None, n: np.ndarray | None) -> pa.RecordBatch:
    nothing = pa.nulls(len(a), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), nothing if b is None else pa.array(b, pa.int64()), nothing if n is None else pa.array(n, pa.int64())], names=["a", "b", "n"])


def _join(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tile = None, None
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b.column(c).to_numpy() for c in (*KEY, "side")], 1).astype(np.int64)
            cut = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            ids, sizes, vectors = b.column("cid").to_numpy(), b.column("size").to_numpy(), b.column("embedding")
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                if key != tuple(keys[lo, :-1]):
                    if tile is not None:
                        yield from tile.end()
                    key = tuple(keys[lo, :-1])
                    tile = _Tile(int(key[1]), int(key[2]), least)
                x = _matrix(vectors.slice(lo, hi - lo), int(key[1]))
                if keys[lo, -1]:
                    yield from tile.stream(ids[lo:hi], sizes[lo:hi], x)
                else:
                    tile.add(ids[lo:hi], sizes[lo:hi], x)
        if tile is not None:
            yield from tile.end()

    return run


def near_duplicates(rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.93, tile: int = TILE) -> DataFrame:
    """(id, n_links, component_id, kept) for each row: the number of other rows with the same label and a cosine of
    at least `least`, the smallest id that is reached by such links, its own included, and whether that is its own.

    A row whose label is null, or whose vector is null, empty, zero or holds null or non-finite components, links with
    nothing; vectors of different lengths do not link. Rows of equal vector and label are found together and counted
    as many. Rows of equal id are all returned. A null id is no component_id unless the row links with none. Other columns
    are not read; an empty table gives no rows. Vectors are shuffled as they are stored, each in 2 rows a block and, in a slab
    of several tiles, one more for each tile that it is compared with."""
    number = "float" if rows.schema[vector_col].dataType.simpleString() == "array<float>" else "double"
    vector = F.col(vector_col).cast(f"array<{number}>")
    prep = rows.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), vector.alias("embedding"))
    fine = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    some = F.exists("embedding", lambda v: v != 0)
    prep = prep.withColumn("valid", F.coalesce(F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~fine & some, F.lit(False)))
    prep = written(prep.withColumn("embedding", F.when(F.col("valid"), F.col("embedding"))), "vectors")
    classes = written(prep.where("valid").groupBy("label", "embedding").agg(F.min("rid").alias("cid"), F.min("id").alias("least"), F.count("*").alias("size")), "classes")

    fields = "cid long, label long, dim int, size long, embedding array<" + number + ">"
    spread = classes.select("cid", "label", F.size("embedding").alias("dim"), "size", "embedding").mapInArrow(_spread(least), fields + ", block int, slab int, guest int")
    group = ["label", "dim", "block", "slab"]
    full = spread.groupBy(*group).agg(F.sum(1 - F.col("guest")).alias("n")).where(F.col("n") > tile)
    full = written(full.select(*group, F.ceil(F.col("n") / tile).cast("int").alias("tiles")), "tiles")  # its size is known to the planner
    dealt = spread.join(full, group, "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    home = F.pmod(F.xxhash64("cid"), F.col("tiles")).cast("int")
    dealt = dealt.withColumn("home", home).withColumn("tile", F.explode(F.when(F.col("guest") == 1, F.sequence(F.lit(0), F.col("tiles") - 1)).otherwise(F.sequence(F.lit(0), F.col("home")))))
    dealt = dealt.withColumn("side", F.when((F.col("guest") == 0) & (F.col("tile") == F.col("home")), 0).otherwise(1))
    dealt = dealt.select(*KEY, "side", "cid", "size", "embedding").repartition(*KEY).sortWithinPartitions(*KEY, "side", "cid")
    found = written(dealt.mapInArrow(_join(least), "a long, b long, n long"), "vector-links")

    links = found.where("n is not null").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("links"))
    joined = components(found.where("b is not null").select("a", "b")).withColumnRenamed("vertex", "cid")
    of = classes.select("cid", "least", "size").join(links, "cid", "left").join(joined, "cid", "left")
    of = written(of.select("cid", "least", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("root", "cid").alias("root")), "vector-roots")
    lowest = written(of.groupBy("root").agg(F.min("least").alias("component")), "vector-least")  # so that a join with a large component's root can be split
    of = of.join(lowest, "root").join(classes.select("cid", F.col("label").alias("_l"), F.col("embedding").alias("_e")), "cid").select("_l", "_e", "n_links", "component")
    out = prep.join(of, (F.col("label") == F.col("_l")) & (F.col("embedding") == F.col("_e")) & F.col("valid"), "left")
    component = F.coalesce("component", "id")
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates among all vectors."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), least=0.93)
    return found.withColumnRenamed("id", "vec_id")
