"""SimHash near-duplicates by a self-join of the binary trie of fingerprints.

The trie is walked by pairs of nodes at equal depth. A pair carries the number of bits in which its
two paths differ and is dropped once that exceeds the budget of its depth; what is left at the leaves
are the fingerprints within the allowed distance.

A pair of 64-bit fingerprints with at most 4 differing bits has, in at least one of the four rotations
by 16 bits, at most 1 differing bit in the first 16, at most 2 in the first 32 and at most 3 in the first
48 (the rotation that starts behind the largest excess of the running sum). So four tries are walked, one
for each rotation, with the budget of a depth growing as the depth does. The first 16 levels are walked by
a shuffle: the paths that differ in at most one of 16 bits are few and known beforehand, so a fingerprint
goes to its own path's subtree and to those of the larger paths one bit away. Subtrees in which too many meet are
taken apart by further bits in the same way. What meets in a subtree is walked together in numpy, in bounded portions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setweave.llm.components import components, forest, spanning
from setweave.llm.frames import free, slices, stamped, written
from setweave.llm.similar import fingerprint, similar_groups

BITS, BLOCKS = 64, 4
DEPTH = BITS // BLOCKS
#: Pairs of fingerprints, and pairs of nodes, that are compared at a time.
PORTION = 1 << 20
#: Pairs of nodes with at most so many pairs of fingerprints are compared outright.
SMALL = 64
#: Bit of a subtree's key from which its rotation stands; the path is below it.
TURN = 48
#: Fingerprints that meet in one subtree, at most, before it is taken apart.
HEAVY = 1 << 20


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            f = np.array([fingerprint(t or b"", words) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(f)], names=[*b.schema.names[:-1], "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, row_col: str | None = None) -> DataFrame:
    """(id, fp) of every whole text, and its row's number (row) if row_col names one; a null text counts as empty. fp has the
    bits of the unsigned value."""
    row = [F.col(row_col).alias("row")] if row_col else []
    rows = docs.select(*row, F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(_fingerprints(words), ("row long, " if row else "") + "id long, fp long")


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each fingerprint in each rotation at its own path of DEPTH bits and, as a guest, at the larger paths one bit away."""
    flips = np.uint64(1) << np.arange(DEPTH, dtype=np.uint64)
    for b in slices(batches, 20_000):
        f = b.column(0).to_numpy().view(np.uint64)
        for r in range(BLOCKS):
            s = np.uint64(r * DEPTH)
            turned = (f << s) | (f >> (np.uint64(BITS) - s)) if r else f
            path = turned >> np.uint64(BITS - DEPTH)
            i, j = np.nonzero((path[:, None] & flips) == 0)
            yield _dealt(np.concatenate([path, path[i] | flips[j]]) | np.uint64(r << TURN), np.repeat([0, 1], [len(f), len(i)]), np.concatenate([turned, turned[i]]))


def _dealt(key: np.ndarray, guest: np.ndarray, turned: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(guest.astype(np.int8)), pa.array(turned.view(np.int64))], names=["key", "guest", "turned"])


def _deepen(most: int, depth: int):
    """Takes subtrees of a depth apart by the next DEPTH bits: a fingerprint at home goes to its own path and visits the larger
    ones within the budget; a guest visits those that are within what its differing bits leave of the budget."""
    masks = np.arange(1 << DEPTH, dtype=np.uint64)
    ones = np.bitwise_count(masks).astype(np.int64)
    order = np.argsort(ones, kind="stable")
    masks, upto = masks[order], np.searchsorted(ones[order], np.arange(BLOCKS + 1), side="right")
    budget = (depth // DEPTH + 1) * most // BLOCKS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2000):
            key, guest, turned = b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy(), b.column(2).to_numpy().view(np.uint64)
            own, at = turned >> np.uint64(BITS - depth), key & np.uint64((1 << TURN) - 1)
            left = budget - np.bitwise_count(own ^ at).astype(np.int64)
            following = (turned >> np.uint64(BITS - depth - DEPTH)) & np.uint64((1 << DEPTH) - 1)
            for n in np.unique(left[left >= 0]).tolist():
                for visit in (0, 1):
                    on = np.flatnonzero((left == n) & (guest == visit))
                    if not len(on):
                        continue
                    to = following[on][:, None] ^ masks[: upto[n]]
                    i, j = np.nonzero((to >= following[on][:, None]) | (visit == 1))
                    i_on, to = on[i], to[i, j]
                    yield _dealt((key[i_on] & ~np.uint64((1 << TURN) - 1)) | (at[i_on] << np.uint64(DEPTH)) | to, np.where((to == following[i_on]) & (visit == 0), 0, 1), turned[i_on])

    return run


def walk(value: np.ndarray, a_lo: np.ndarray, a_hi: np.ndarray, b_lo: np.ndarray, b_hi: np.ndarray, diff: np.ndarray, most: int, depth: int = DEPTH) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Walks pairs of trie nodes down to the pairs of positions whose values differ in at most `most` bits.

    A node of a depth is a range of positions of value (unsigned, sorted within each first range given) that
    agree in so many bits; a range paired with itself stands for its pairs of different positions."""
    ones: dict[int, np.ndarray] = {}

    def split(lo: np.ndarray, hi: np.ndarray, d: int) -> np.ndarray:
        if d not in ones:
            ones[d] = np.concatenate([[0], np.cumsum((value >> np.uint64(BITS - 1 - d)) & np.uint64(1))]).astype(np.int64)
        return hi - (ones[d][hi] - ones[d][lo])

    stack = [(depth, a_lo, a_hi, b_lo, b_hi, diff)]
    while stack:
        d, al, ah, bl, bh, df = stack.pop()
        if len(al) > PORTION // 8:
            k = len(al) // 2
            stack += [(d, al[k:], ah[k:], bl[k:], bh[k:], df[k:]), (d, al[:k], ah[:k], bl[:k], bh[:k], df[:k])]
            continue
        n = (ah - al) * (bh - bl)
        end = (n <= SMALL) | (d == BITS)
        # compare the small ones outright, in portions
        for part in np.array_split(np.nonzero(end)[0], max(1, int(n[end].sum() // PORTION))):
            if not len(part):
                continue
            w, m = bh[part] - bl[part], n[part]
            which = np.repeat(np.arange(len(part)), m)
            at = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
            i, j = al[part][which] + at // w[which], bl[part][which] + at % w[which]
            good = (np.bitwise_count(value[i] ^ value[j]) <= most) & ((al[part] != bl[part])[which] | (i < j))
            if good.any():
                yield i[good], j[good]
        go = ~end
        if not go.any():
            continue
        al, ah, bl, bh, df = al[go], ah[go], bl[go], bh[go], df[go]
        same = al == bl
        am, bm = split(al, ah, d), split(bl, bh, d)
        budget = -(-(d + 1) // DEPTH) * most // BLOCKS
        parts = [(al, am, bl, bm, df, np.ones(len(al), bool)), (am, ah, bm, bh, df, np.ones(len(al), bool)), (al, am, bm, bh, df + 1, np.ones(len(al), bool)), (am, ah, bl, bm, df + 1, ~same)]
        cat = [np.concatenate([p[k][p[5] & (p[0] < p[1]) & (p[2] < p[3]) & (p[4] <= budget)] for p in parts]) for k in range(5)]
        if len(cat[0]):
            stack.append((d + 1, *cat))


def _meet(most: int, depth: int, real: bool):
    tree = spanning if real else forest

    def links(key: np.ndarray, guest: np.ndarray, value: np.ndarray, done: np.uint64 | None) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((value, guest, key))
        key, guest, value = key[order], guest[order], value[order]
        path = value >> np.uint64(BITS - depth)
        # nodes: ranges of one subtree and one path; the guests' paths differ from its own
        fresh = (key[1:] != key[:-1]) | (guest[1:] != guest[:-1]) | (path[1:] != path[:-1])
        lo = np.concatenate([[0], np.nonzero(fresh)[0] + 1])
        hi = np.concatenate([lo[1:], [len(key)]])
        subtree = np.cumsum(np.concatenate([[0], key[lo[1:]] != key[lo[:-1]]])).astype(np.int64)
        mine = np.nonzero(guest[lo] == 0)[0]
        host = np.full(subtree[-1] + 1, -1)
        host[subtree[mine]] = mine
        visit = np.nonzero(guest[lo] == 1)[0]
        visit = visit[host[subtree[visit]] >= 0]
        if done is not None:  # the homes of this subtree have met before
            mine = mine[key[lo[mine]] != done]
        x, y = np.concatenate([mine, host[subtree[visit]]]), np.concatenate([mine, visit])
        diff = np.bitwise_count(path[lo[x]] ^ path[lo[y]]).astype(np.int64)
        turn = (key.astype(np.int64) >> TURN) * DEPTH
        for i, j in walk(value, lo[x], hi[x], lo[y], hi[y], diff, most, depth):
            s = turn[i].astype(np.uint64)
            back = lambda v: np.where(s > 0, (v >> s) | (v << ((np.uint64(BITS) - s) & np.uint64(63))), v).view(np.int64)  # noqa: B023, E731
            u, v = tree(back(value[i]), back(value[j]))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size, done = 0, None
        for b in batches:
            held.append([b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy(), b.column(2).to_numpy().view(np.uint64)])
            size += b.num_rows
            if size < PORTION // 2:
                continue
            rows = [np.concatenate(x) for x in zip(*held, strict=True)]
            k = int(np.searchsorted(rows[0], rows[0][-1]))  # the last subtree may go on
            if k:
                yield from links(*[x[:k] for x in rows], done)
                rows, done = [x[k:] for x in rows], None
            if len(rows[0]) >= PORTION // 2 and rows[1][-1]:  # its homes are all here: its guests are seen off as they come
                yield from links(*rows, done)
                done, rows = rows[0][0], [x[rows[1] == 0] for x in rows]
            held, size = [rows], 0 if done is not None else len(rows[0])
        if sum(len(h[0]) for h in held):
            yield from links(*[np.concatenate(x) for x in zip(*held, strict=True)], done)

    return run


DEALT = "key long, guest tinyint, turned long"


def _loads(distinct: DataFrame) -> DataFrame:
    """(key, n): how many fingerprints meet in each subtree of DEPTH bits; there are 4 x 65,536 of these at most."""
    path = [F.shiftrightunsigned("fp", BITS - DEPTH * (r + 1)).bitwiseAND((1 << DEPTH) - 1) + (r << TURN) for r in range(BLOCKS)]
    homes = distinct.select(F.explode(F.array(*path)).alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    larger = f"explode(concat(array(key), transform(filter(sequence(0, {DEPTH - 1}), i -> (key & shiftleft(1L, i)) = 0), i -> key | shiftleft(1L, i))))"
    return homes.select(F.expr(larger).alias("key"), "n").groupBy("key").agg(F.sum("n").alias("n"))


def links(distinct: DataFrame, most: int = 4, *, real: bool = False, heavy: int = HEAVY) -> DataFrame:
    """Edges (a, b) over the values of the column fp that join exactly those reachable by steps of at most
    `most` (4 or fewer) differing bits. The values should be distinct; they are not gathered anywhere. With real, every
    edge is itself such a step.

    A subtree in which more than `heavy` fingerprints meet is taken apart by the next 16 bits, and again by 16 more."""
    if not 0 <= most <= BLOCKS:
        raise ValueError("the four rotations hold for at most 4 differing bits")
    distinct = distinct.where("fp is not null").select("fp")
    dealt, out = distinct.mapInArrow(_spread, DEALT), None
    meet = lambda rows, depth: rows.repartition("key").sortWithinPartitions("key", "guest").mapInArrow(_meet(most, depth, real), "a long, b long")
    for depth in range(DEPTH, BITS, DEPTH):
        loads = _loads(distinct) if depth == DEPTH else dealt.groupBy("key").agg(F.count("*").alias("n"))
        over = written(loads.where(F.col("n") > heavy).select("key"), "heavy") if depth + DEPTH < BITS else None
        split = over is not None and over.take(1)
        found = meet(dealt.join(over, "key", "left_anti") if split else dealt, depth)
        out = found if out is None else out.unionByName(found)
        if not split:
            return out
        dealt = dealt.join(over, "key", "left_semi").mapInArrow(_deepen(most, depth), DEALT)


def _rooted(fps: DataFrame, most: int) -> DataFrame:
    """(fp, root, least): for each fingerprint of (id, fp) the one that stands for its component, and its smallest id."""
    classes = fps.groupBy("fp").agg(F.min("id").alias("least"))
    found = components(links(classes, most))
    return written(classes.join(found.withColumnRenamed("vertex", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "roots")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 4, most: int = 4) -> DataFrame:
    """(id, fingerprint, component_id, fp) for each row of docs; component_id is the smallest id that is reached by
    steps between fingerprints of at most `most` differing bits, the row's own included.

    Null and empty texts have fingerprint zero and are linked like any other; rows with equal text or equal id
    are all returned; a null id is never a component_id unless all of its component are null. Other columns of
    docs are not read; an empty table gives no row."""
    fps = written(fingerprints(docs, id_col, text_col, words), "simhash")
    roots = _rooted(fps, most)
    least = written(roots.groupBy("root").agg(F.min("least").alias("component_id")), "least")  # written, so that a join with a large component's root can be split
    of = roots.join(least, "root").select("fp", "component_id")
    return fps.join(of, "fp").select("id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "fp")


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 4, most: int = 4, similarity: tuple[int, int] | None = None) -> DataFrame:
    """One row of each group of near duplicates, with all its columns: that of the smallest id, a null id last; of rows with
    this id any one, the same in every run over the same table.

    Rows are told apart by their place, not by their id: rows of one id in different groups are kept in each, repeated rows
    once. Null, empty and blank texts are one group. Without similarity a group is what steps of at most `most` differing
    bits reach; with a fraction, what steps between texts reach whose sets of shingles have at least that Jaccard similarity:
    the trie's pairs are checked on the whole sets, and what few bits cannot show is found by similar.similar_groups."""
    row = free(docs.columns, "_row")
    rows = stamped(docs, row)
    if similarity is None:
        fps = written(fingerprints(rows, id_col, text_col, words, row), "simhash")
        found = fps.join(_rooted(fps, most), "fp").select("row", "id", "root")
    else:
        found = similar_groups(rows, lambda distinct: links(distinct, most, real=True), row_col=row, id_col=id_col, text_col=text_col, words=words, similarity=similarity)
    first = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first")).select(F.col("first.row").alias(row))
    return rows.join(first, row, "left_semi").drop(row)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints and near-duplicate components of all documents."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=4, most=4)
    return found.select(F.col("id").alias("doc_id"), "fingerprint", "component_id")
