"""Groups of texts by the Jaccard similarity of their word shingles, every link checked on the whole sets.

Rows of equal sets are one vertex. First the SimHash trie's pairs are checked. At a similarity of 0.8 two fingerprints of 64 bits
differ in 10 bits or so, more than a trie can be walked with; so the pairs that it cannot show are found by shared bands of
min-hash values: BANDS bands of ROWS values miss a pair at 0.8 with probability 3e-6, a more similar one less often.
A band's key may have a large group of copies; so its members are first linked in a chain. Where that leaves a key's members in
several components, all of them are compared by an inverted index of their shingles, tile by tile: a tile's rows are
held, the others stream by. Only the edges of spanning forests leave a task, never pairs that it has compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from setweave.llm.components import components, forest
from setweave.llm.frames import slices, written

BANDS, ROWS = 32, 5
#: Shingles that are min-hashed, and whose bits are counted, at a time.
CHUNK, BIT_CHUNK = 512, 1 << 17
#: Bytes of the sets that a tile holds, about.
TILE_BYTES = 16 << 20
_rng = np.random.default_rng(5)
_XOR, _ODD = (_rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1) for _ in range(2))
_MIX = _rng.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)


def hashes(text: bytes, words: int, seed: int = 42) -> np.ndarray:
    """The XXH64 of a text's shingles in UTF-8, repeats included; A-Z lower-cased. Fewer words make one shingle, no word none."""
    parts = text.lower().split()
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(parts), seed)] if parts else [], np.uint64)
    line, ends = b" ".join(parts), np.cumsum([len(p) + 1 for p in parts])
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[i:j], seed) for i, j in zip([0, *ends[:-words].tolist()], (ends[words - 1 :] - 1).tolist(), strict=True)], np.uint64)


def majority(h: np.ndarray) -> int:
    """The unsigned number whose bits are those set in over half of the hashes; zero for none."""
    if len(h) < 2:
        return int(h[0]) if len(h) else 0
    h = h.astype(">u8")
    # bits of so many hashes at most at once, whatever the text's length
    count = sum(np.unpackbits(h[k : k + BIT_CHUNK].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64) for k in range(0, len(h), BIT_CHUNK))
    return int.from_bytes(np.packbits(2 * count > len(h)).tobytes(), "big")


def fingerprint(text: bytes, words: int = 4, seed: int = 42) -> int:
    """The unsigned SimHash fingerprint of a text in UTF-8: a bit is set if it is in over half of the hashes of the
    text's shingles, repeats included. Fewer words make one shingle; no word gives zero."""
    return majority(hashes(text, words, seed))


def shingles(text: bytes, words: int = 5) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    return np.unique(hashes(text, words))


def band_keys(distinct: np.ndarray) -> np.ndarray:
    """A key for each band of a set's min-hash values; none for an empty set."""
    if not len(distinct):
        return np.zeros(0, np.int64)
    high = (distinct >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, np.uint32)
    for k in range(0, len(high), CHUNK):
        mixed = high[k : k + CHUNK, None] ^ _XOR
        mixed *= _ODD
        np.minimum(least, mixed.min(0), out=least)
    wide = least.astype(np.uint64)
    return (((wide ^ (wide << np.uint64(29))) * _MIX).reshape(BANDS, ROWS).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


SKETCH = "row long, id long, digest binary, fp long, keys array<long>"


def _sketches(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            every = [hashes(t or b"", words) for t in b.column(2).to_pylist()]
            sets = [np.unique(h) for h in every]
            digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            fps = np.array([majority(h) for h in every], np.uint64).view(np.int64)
            keys = pa.array([band_keys(s) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(digests, pa.binary()), pa.array(fps), keys], names=["row", "id", "digest", "fp", "keys"])

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t or b"", words).tobytes() for t in b.column(1).to_pylist()], pa.binary())], names=["row", "shingles"])

    return run


def _similar(numerator: int, denominator: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            good = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(s, t, assume_unique=True))
                good.append(denominator * both >= numerator * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (key, row) with equal keys side by side, the pairs of neighbours (a, b), and of each key's first row the key as well."""
    key, row = None, None
    for b in batches:
        if not b.num_rows:
            continue
        keys, rows = b.column(0).to_numpy(), b.column(1).to_numpy()
        before = np.concatenate([rows[:1] if row is None else [row], rows[:-1]])
        first = np.concatenate([[key is None or key != keys[0]], keys[1:] != keys[:-1]])
        key, row = keys[-1], rows[-1]
        yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(before, mask=first), pa.array(keys, mask=~first)], names=["a", "b", "key"])


class _Tile:
    """The sets of a tile, and the links between their components and those of the sets that stream by."""

    def __init__(self, numerator: int, denominator: int):
        self.numerator, self.denominator = numerator, denominator
        self.sets, self.roots, self.edges, self.ready = [], [], [], False

    def add(self, root: int, s: np.ndarray) -> None:
        self.sets.append(s)
        self.roots.append(root)

    def close(self) -> None:
        if not self.ready:
            self.ready, self.root = True, np.array(self.roots, np.int64)
            self.size = np.array([len(s) for s in self.sets], np.int64)
            every = np.concatenate([*self.sets, np.zeros(0, np.uint64)])
            order = np.argsort(every, kind="stable")
            self.owner = np.repeat(np.arange(len(self.sets)), self.size)[order]
            self.value, self.begin = np.unique(every[order], return_index=True)
            self.end = np.append(self.begin[1:], len(every))
            for i, s in enumerate(self.sets):
                self._compare(self.roots[i], s, i)
            self.sets.clear()

    def _compare(self, root: int, s: np.ndarray, upto: int) -> None:
        at = np.searchsorted(self.value, s)
        at = at[self.value[np.minimum(at, len(self.value) - 1)] == s] if len(self.value) else at[:0]
        n = self.end[at] - self.begin[at]
        owners = self.owner[np.repeat(self.begin[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        both = np.bincount(owners, minlength=len(self.size))[:upto]
        near = np.flatnonzero((self.denominator * both >= self.numerator * (self.size[:upto] + len(s) - both)) & (self.root[:upto] != root))
        if len(near):
            other = np.unique(self.root[near])
            self.edges.append((np.full(len(other), root), other))

    def stream(self, root: int, s: np.ndarray) -> None:
        self.close()
        if len(self.size):
            self._compare(root, s, len(self.size))

    def done(self) -> Iterator[pa.RecordBatch]:
        self.close()
        if self.edges:
            a, b = forest(*[np.concatenate(x) for x in zip(*self.edges, strict=True)])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
        self.edges = []


def _within(numerator: int, denominator: int):
    """From (key, tile, side, root, shingles) in this order, edges (a, b) that join the roots of a tile's similar sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tile = None, None
        for b in batches:
            for key, number, side, root, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4), strict=True):
                if at != (key, number):
                    if tile is not None:
                        yield from tile.done()
                    at, tile = (key, number), _Tile(numerator, denominator)
                s = np.frombuffer(s.as_buffer(), np.uint64)
                if side:
                    tile.stream(root, s)
                else:
                    tile.add(root, s.copy())
                if len(tile.edges) >= 1 << 14:
                    tile.edges = [forest(*[np.concatenate(x) for x in zip(*tile.edges, strict=True)])]
        if tile is not None:
            yield from tile.done()

    return run


def similar_groups(rows: DataFrame, links: Callable[[DataFrame], DataFrame], *, row_col: str, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: tuple[int, int] = (4, 5), tile_bytes: int = TILE_BYTES) -> DataFrame:
    """(row, id, root) for each of the rows; root stands for the rows that are reached by steps between texts whose shingles
    have a Jaccard similarity of at least the fraction. links gives, of distinct fingerprints (fp), pairs (a, b) of near ones.
    row_col is unique and stable, a column of a written table.

    Null and empty texts and those of white space have no shingle and are one group; an empty table gives no rows. Rows of
    equal id, and ids that are null, are told apart by row."""
    text = F.col(text_col).cast("string").cast("binary").alias("text")
    row = F.col(row_col).alias("row")
    sketches = written(rows.select(row, F.col(id_col).cast("long").alias("id"), text).mapInArrow(_sketches(words), SKETCH), "sketches")
    reps = written(sketches.groupBy("digest").agg(F.min("row").alias("rep")), "reps")
    classes = written(sketches.join(reps.select("rep"), F.col("row") == F.col("rep"), "left_semi").select("digest", F.col("row").alias("rep"), "fp", "keys"), "classes")
    bands = classes.select(F.col("rep").alias("row"), F.explode("keys").alias("key"))
    shared = bands.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    bands = written(bands.join(shared, "key").select("key", "row"), "bands")

    heads = written(classes.groupBy("fp").agg(F.min("rep").alias("head")), "heads")
    head = lambda x: heads.select(F.col("fp").alias(x), F.col("head").alias(f"h_{x}"))
    near = links(heads.select("fp")).distinct().join(head("a"), "a").join(head("b"), "b").select(F.col("h_a").alias("a"), F.col("h_b").alias("b"))
    equal = classes.join(heads, "fp").where("rep != head").select(F.col("rep").alias("a"), F.col("head").alias("b"))
    near = written(near.unionByName(equal), "near")
    wanted = bands.select("row").unionByName(near.select(F.col("a").alias("row"))).unionByName(near.select(F.col("b").alias("row"))).distinct()
    sets = written(rows.select(row, text).join(wanted, "row", "left_semi").mapInArrow(_sets(words), "row long, shingles binary"), "shingles")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        a, b = (sets.select(F.col("row").alias(x), F.col("shingles").alias(f"s_{x}")) for x in "ab")
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        return written(pairs.join(a, "a").join(b, "b").select("a", "b", "s_a", "s_b").mapInArrow(_similar(*similarity), "a long, b long"), name)

    def rooted(edges: DataFrame) -> DataFrame:
        of = written(components(edges).withColumnRenamed("vertex", "row"), "rooted")
        return written(bands.join(of, "row", "left").select("key", F.coalesce("root", "row").alias("root"), "row"), "named")

    edges = verified(near, "near-links")
    # members of a key that are not joined yet, in random order; a large key goes to several tasks
    one = rooted(edges).select("key", "root").distinct().withColumnRenamed("root", "row").withColumn("order", F.xxhash64("key", "row"))
    chain = written(one.repartitionByRange("key", "order").sortWithinPartitions("key", "order").select("key", "row").mapInArrow(_chain, "a long, b long, key long"), "chain")
    before = F.lag("a").over(Window.partitionBy("key").orderBy("a"))  # a row for each task that has the key
    across = chain.where("key is not null").select("a", before.alias("b"))
    edges = edges.unionByName(verified(chain.select("a", "b").unionByName(across).where("b is not null"), "chain-links"))

    named = rooted(edges)
    crossed = named.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    members = written(named.join(written(crossed, "crossed"), "key").join(sets, "row"), "members")
    full = members.groupBy("key").agg(F.ceil(F.sum(F.octet_length("shingles")) / tile_bytes).cast("int").alias("tiles")).where("tiles > 1")
    dealt = members.join(written(full, "full"), "key", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    dealt = dealt.withColumn("home", F.pmod(F.xxhash64("row"), F.col("tiles")).cast("int")).withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("home"))))
    dealt = dealt.select("key", "tile", (F.col("tile") != F.col("home")).cast("int").alias("side"), "root", "shingles").repartition("key", "tile").sortWithinPartitions("key", "tile", "side")
    rest = written(dealt.mapInArrow(_within(*similarity), "a long, b long"), "rest")
    found = written(components(edges.unionByName(rest)).withColumnRenamed("vertex", "rep"), "found")
    roots = classes.select("digest", "rep").join(found, "rep", "left").select("digest", F.coalesce("root", "rep").alias("root"))
    return sketches.select("row", "id", "digest").join(roots, "digest").select("row", "id", "root")
