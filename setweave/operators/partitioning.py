"""Learned partitions of a collection: path counters of sets, initial groups, and repeated binary splits."""

from __future__ import annotations

import time
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from setweave.functions import bounds as B
from setweave.operators.elements import numbered
from setweave.sources.shared import exists, swept, written

INITIAL = 128
#: Rows of a group on which a split is learned, and the size below which a group stays whole.
SPLIT_SAMPLE, SPLIT_LEAST = 200, 50
#: Sets of a group, about, that are sent to their sides together; a group of so many sets and tokens at most is halved to the
#: last level in one task; nets that are trained side by side.
CHUNK, CHUNK_TOKENS, NETS = 20_000, 1 << 21, 16
GROUPS = "group_id int, id long"


def path_counters(pairs: DataFrame, universe: int) -> DataFrame:
    """(id, dim, count): of each set's whole-number tokens below the universe, how many fall into the lower (even dim) and
    the upper half (odd dim) of their range at each level of halving."""
    levels = B.path_dimensions(universe) // 2
    if not levels:
        return pairs.select("id", F.lit(0).alias("dim"), F.lit(0).cast("long").alias("count")).limit(0)
    rows = pairs.select("id", "token", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("b"))
    return rows.groupBy("id", (2 * F.col("b") + B.path_bit("token", F.lit(universe), "b")).cast("int").alias("dim")).agg(F.count("*").alias("count"))


def path_vectors(pairs: DataFrame, universe: int) -> DataFrame:
    """(id, dim, value): path counters over the largest of all; the absent ones are zero and left out."""
    c = path_counters(pairs, universe)
    top = c.agg(F.greatest(F.max("count"), F.lit(1)).alias("top"))
    return c.crossJoin(F.broadcast(top)).select("id", "dim", (F.col("count") / F.col("top")).alias("value"))


def initial_groups(pairs: DataFrame, initial: int = INITIAL, ids: DataFrame | None = None) -> DataFrame:
    """(group_id, id): sets by smallest token, then id, cut into `initial` runs of equal length; what is left over is one
    group more. ids (id) adds the empty sets, which pairs cannot show; they come last. Fewer sets than groups are refused."""
    least = pairs.groupBy("id").agg(F.min("token").alias("least"))
    if ids is not None:
        least = ids.select("id").distinct().join(least, "id", "left")
    n = least.count()
    if n < initial:
        raise ValueError(f"{n} sets are fewer than {initial} groups")
    ranked = numbered(least.withColumn("empty", F.col("least").isNull()), "r", "empty", "least", "id")
    return ranked.select(F.floor(F.col("r") / (n // initial)).cast("int").alias("group_id"), "id")


def _layers(nets: np.ndarray, dims: int) -> list[np.ndarray]:
    """The weights and then the biases of nets (net, parameter), as views: two hidden layers of eight units and one output."""
    out, k = [], 0
    for r, c in ((dims, 8), (8, 8), (8, 1), (1, 8), (1, 8), (1, 1)):
        out.append(nets[:, k : k + r * c].reshape(len(nets), r, c))
        k += r * c
    return out


def _forward(layers: list[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hidden units and the outputs of each net for its sets, x (net, set, dimension)."""
    w1, w2, w3, b1, b2, b3 = layers
    one = x @ w1
    one += b1
    np.maximum(one, 0, out=one)
    two = one @ w2
    two += b2
    np.maximum(two, 0, out=two)
    y = (two @ w3 + b3)[:, :, 0]
    return one, two, 1 / (1 + np.exp(-np.clip(y, -30, 30)))


def fit_nets(x: np.ndarray, i: np.ndarray, j: np.ndarray, apart: np.ndarray, seed: int, epochs: int = 3, batch: int = 256, rate: float = 0.01) -> np.ndarray:
    """Nets (net, parameter) that send the sets of x (net, set, dimension) to one of two sides so that distant ones fall apart.

    Adam on the pairs (i, j), the same of all nets, with distances apart (net, pair): a pair on one side of a half costs its
    distance times what its outputs lack of a half. Nets take their steps together and do not depend on one another."""
    many, n, dims = x.shape
    rng, sizes = np.random.default_rng(seed), [dims, 8, 8, 1]
    begin = [rng.normal(0, (2 / a) ** 0.5, (a, b)).ravel() for a, b in zip(sizes, sizes[1:], strict=False)]
    nets = np.repeat(np.concatenate([*begin, np.zeros(17)])[None], many, 0)
    g, m, v = (np.zeros_like(nets) for _ in range(3))
    layers, grads, step = _layers(nets, dims), _layers(g, dims), 0
    turned = lambda z: z.transpose(0, 2, 1)
    ones, row = np.ones((1, n)), (np.arange(many) * n)[:, None]
    for _ in range(epochs):
        for k in range(0, len(i), batch):
            a, b = i[k : k + batch], j[k : k + batch]
            one, two, y = _forward(layers, x)  # each set once, however many of the batch's pairs have it
            f = np.sign(y[:, a] - y[:, b])
            f *= apart[:, k : k + batch]
            f *= (y[:, a] > 0.5) == (y[:, b] > 0.5)
            f /= -len(a)
            back = np.bincount((row + a).ravel(), f.ravel(), many * n) - np.bincount((row + b).ravel(), f.ravel(), many * n)
            back = (back.reshape(many, n) * y * (1 - y))[:, :, None]
            grads[2][...], grads[5][...] = turned(two) @ back, ones @ back
            back = back * turned(layers[2])
            back *= two > 0
            grads[1][...], grads[4][...] = turned(one) @ back, ones @ back
            back = back @ turned(layers[1])
            back *= one > 0
            grads[0][...], grads[3][...] = turned(x) @ back, ones @ back
            step += 1
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            nets -= rate / (1 - 0.9**step) * m / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return nets


def _upper(net: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whether a net sends each of the sets x (set, dimension) to the upper side."""
    return _forward(_layers(net[None], x.shape[1]), x[None])[2][0] > 0.5


def learned_nets(x: np.ndarray, apart: list[np.ndarray], level: int) -> list[np.ndarray]:
    """For samples of groups, x (group, set, dimension) with the distances of their sets, the trained nets, empty where all of
    a sample goes to one side."""
    i, j = np.nonzero(~np.eye(x.shape[1], dtype=bool))
    order = np.random.default_rng(level).permutation(len(i))
    i, j = i[order], j[order]
    nets = fit_nets(x, i, j, np.stack([d[i, j] for d in apart]), level)
    up = _forward(_layers(nets, x.shape[2]), x)[2] > 0.5
    return [net if u.any() and not u.all() else net[:0] for net, u in zip(nets, up, strict=True)]


def with_counters(pairs: DataFrame, universe: int) -> DataFrame:
    """(id, n, tokens, x): the sets with their numbers of tokens and path counters, as arrays of all dimensions."""
    dims = B.path_dimensions(universe)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = pc.list_value_length(b.column(1)).to_numpy().astype(np.int64)
            t, row = pc.list_flatten(b.column(1)).to_numpy(), np.repeat(np.arange(len(n)), n)
            x = np.zeros((len(n), max(dims, 1)), np.int32)
            for k in range(dims // 2):
                x[:, 2 * k + 1] = np.bincount(row, np.floor(t / (universe / 2 / 2.0**k)) % 2, len(n))
                x[:, 2 * k] = n - x[:, 2 * k + 1]
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n.astype(np.int32)), b.column(1), flat], names=["id", "n", "tokens", "x"])

    sets = pairs.groupBy("id").agg(F.collect_list(F.col("token").cast("long")).alias("tokens"))
    return sets.mapInArrow(run, "id long, n int, tokens array<long>, x array<int>")


def _dice(n: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """1 - 2 common / (n_i + n_j) of all pairs of sets of n tokens each, which follow one another."""
    names, t = np.unique(tokens, return_inverse=True)
    token, row = np.divmod(np.unique(t * len(n) + np.repeat(np.arange(len(n)), n)), len(n))
    many = np.bincount(token, minlength=len(names))
    if (many**2).sum() * 16 < len(n) ** 2 * len(names):  # few sets have a token in common: their pairs are counted
        of = np.repeat(np.arange(len(row)), many[token])
        at = np.arange(len(of)) + np.repeat((np.cumsum(many) - many)[token] - np.cumsum(many[token]) + many[token], many[token])
        common = np.bincount(row[of] * len(n) + row[at], minlength=len(n) ** 2).reshape(len(n), -1)
    else:
        common = np.zeros((len(n), len(n)))
        for a in range(0, len(names), 4096):  # a part of the tokens at a time
            on = slice(*np.searchsorted(token, (a, a + 4096)))
            held = np.zeros((len(n), min(4096, len(names) - a)), np.float32)
            held[row[on], token[on] - a] = 1
            common += held @ held.T
    return 1 - 2 * common / np.maximum(1, n[:, None] + n)


def dice_distances(tokens: list, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """1 - 2 common / (n_i + n_j) of pairs of sets."""
    return _dice(np.array([len(t) for t in tokens]), np.concatenate([np.asarray(x) for x in tokens]))[i, j]


def split_level(groups: DataFrame, vectors: DataFrame | None, top: int, level: int, learned: bool = False) -> DataFrame:
    """(group_id, id): every group of SPLIT_LEAST sets or more cut in two; group g becomes 2g and 2g + 1.

    The learned split is trained on SPLIT_SAMPLE sets of the group at most, by Dice distances of their pairs; then every set
    of the group is sent to its side row by row, so no group has to fit a task. Otherwise sets go by the parity of their
    hash, as they also do where a learned split sends all to one side of the sample. vectors has the sets' tokens and counters
    (with_counters), of which top is the largest."""
    sized = groups.join(groups.groupBy("group_id").agg(F.count("*").alias("size")), "group_id")
    side = F.pmod(F.xxhash64("id", F.lit(level)), F.lit(2))
    if not learned:
        return sized.select((2 * F.col("group_id") + F.when(F.col("size") < SPLIT_LEAST, 0).otherwise(side)).cast("int").alias("group_id"), "id")
    place = F.row_number().over(Window.partitionBy("group_id").orderBy(F.xxhash64("id", F.lit(level)), "id"))
    sample = sized.where(F.col("size") >= SPLIT_LEAST).withColumn("place", place).where(F.col("place") <= SPLIT_SAMPLE).join(vectors, "id")

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        x = np.array(pdf["x"].tolist(), float) / top
        apart = _dice(np.array([len(t) for t in pdf["tokens"]]), np.concatenate([np.asarray(t) for t in pdf["tokens"]]))
        return pd.DataFrame({"group_id": [int(pdf["group_id"].iloc[0])], "net": [learned_nets(x[None], [apart], level)[0].tolist()]})

    # by number, or all groups' few rows would be joined to one task, which trains one net after the other
    tasks = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    nets = written(sample.select("group_id", "place", "x", "tokens").repartition(tasks, "group_id").groupBy("group_id").applyInPandas(learn, "group_id int, net array<double>"), "nets")

    def send(parts):
        models = {}
        for pdf in parts:
            head = pdf["net"].notna().to_numpy()
            models |= dict(zip(pdf["group_id"].to_numpy()[head].tolist(), pdf["net"][head], strict=True))
            pdf = pdf[~head]
            out = pdf["parity"].to_numpy() * (pdf["size"].to_numpy() >= SPLIT_LEAST)
            for g, at in pdf.groupby("group_id").indices.items():
                if len(net := models.get(g, ())):
                    out[at] = _upper(np.array(net), np.stack(pdf["x"].iloc[at].to_numpy()) / top)
            last = pdf["group_id"].iloc[-1:].tolist()  # rows come by group
            models = {g: n for g, n in models.items() if not last or g >= last[0]}
            yield pd.DataFrame({"group_id": 2 * pdf["group_id"].to_numpy() + out, "id": pdf["id"]})

    # a net goes once to each chunk of its group, ahead of the chunk's sets, never along with a set
    chunks = F.floor((F.col("size") - 1) / CHUNK).cast("int")
    heads = nets.join(sized.select("group_id", "size").distinct(), "group_id").select("group_id", F.explode(F.sequence(F.lit(0), chunks)).alias("chunk"), F.lit(0).cast("long").alias("id"), "size", F.array().cast("array<int>").alias("x"), F.lit(0).alias("parity"), "net")
    body = sized.join(vectors.select("id", "x"), "id").select("group_id", F.pmod(F.xxhash64("id", F.lit(-1)), chunks + 1).cast("int").alias("chunk"), "id", "size", "x", side.cast("int").alias("parity"), F.lit(None).cast("array<double>").alias("net"))
    dealt = heads.unionByName(body).repartition(tasks, "group_id", "chunk").sortWithinPartitions("group_id", F.col("net").isNull())
    return dealt.select("group_id", "id", "size", "x", "parity", "net").mapInPandas(send, GROUPS)


def split_whole(groups: DataFrame, vectors: DataFrame, top: int, level: int, levels: int) -> DataFrame:
    """(group_id, id): what split_level would give at the levels from one to the last, learned, of groups that each fit a task.
    The groups that a task has made are trained side by side."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("id").combine_chunks()
        value = lambda c: table.column(c).chunk(0)
        ids, n, tokens = value("id").to_numpy(), value("n").to_numpy().astype(np.int64), pc.list_flatten(value("tokens")).to_numpy()
        x, hashes = (pc.list_flatten(value(c)).to_numpy().reshape(len(ids), -1) for c in ("x", "hashes"))
        x, stop = x / top, np.cumsum(n)
        group = value("group_id").to_numpy().astype(np.int64)
        for k in range(levels - level):
            order, h = np.lexsort((ids, hashes[:, k], group)), hashes[:, k]
            cuts = np.flatnonzero(np.diff(group[order])) + 1
            parts = [p for p in np.split(order, cuts) if len(p) >= SPLIT_LEAST]
            side, alike = np.zeros(len(ids), np.int64), {}
            for p in parts:
                side[p] = h[p] & 1
                alike.setdefault(min(len(p), SPLIT_SAMPLE), []).append(p)
            for size, of in alike.items():
                for a in range(0, len(of), NETS):
                    some = [p[:size] for p in of[a : a + NETS]]
                    apart = [_dice(n[p], np.concatenate([tokens[stop[r] - n[r] : stop[r]] for r in p])) for p in some]
                    for p, net in zip(of[a : a + NETS], learned_nets(x[np.stack(some)], apart, level + k), strict=True):
                        if len(net):
                            side[p] = _upper(net, x[p])
            group = 2 * group + side
        return pa.table([pa.array(group.astype(np.int32)), value("id")], names=["group_id", "id"])

    tasks = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashes = F.array(*[F.xxhash64("id", F.lit(k)) for k in range(level, levels)]).alias("hashes")
    rows = groups.join(vectors, "id").select("group_id", "id", "n", "tokens", "x", hashes)
    return rows.repartition(tasks, "group_id").groupBy("group_id").applyInArrow(run, GROUPS)


def partition(pairs: DataFrame, universe: int, *, initial: int = INITIAL, share: float = 0.005, learned: bool = False, folder: str | None = None) -> DataFrame:
    """(group_id, id): the initial groups, halved until there are `share` of the sets as many. Each level is written to
    the shared folder, so a lost executor costs one level; learned groups that fit a task go through all that are left there,
    but with a folder. Both ways give the same groups.

    With a folder, which belongs to one collection and its options, levels stay there (level-0 and on) and a later call goes on
    behind the last one that is whole; timings holds the number of groups and the seconds of each level as JSON lines."""
    spark = pairs.sparkSession
    n = pairs.select("id").distinct().count()
    levels = B.split_targets(n, initial, share)[1]
    at = lambda level: f"{folder}/level-{level}"
    first = next((level + 1 for level in range(levels - 1, -1, -1) if folder and exists(spark, f"{at(level)}/_SUCCESS")), 0)
    groups = spark.read.schema(GROUPS).parquet(at(first - 1)) if first else initial_groups(pairs, initial)
    if first == levels:
        return groups
    vectors, top, done = None, 1, []
    if learned:
        groups = written(groups, "initial")
        vectors = written(with_counters(pairs, universe), "vectors")
        swept(spark)
        top = max(1, vectors.agg(F.max(F.array_max("x"))).first()[0])
    for level in range(first, levels):
        if learned and not folder:
            sizes = groups.join(vectors.select("id", "n"), "id").groupBy("group_id").agg(F.count("*").alias("size"), F.sum("n").alias("n"))
            fits = written(sizes.select("group_id", ((F.col("size") <= CHUNK) & (F.col("n") <= CHUNK_TOKENS)).alias("fits")), "sizes")
            kinds = {r["fits"] for r in fits.select("fits").distinct().collect()}
            if True in kinds:
                done.append(written(split_whole(groups.join(fits.where("fits"), "group_id", "left_semi"), vectors, top, level, levels), "leaves"))
                swept(spark)
            if False not in kinds:
                break
            groups = groups.join(fits.where("not fits"), "group_id", "left_semi")
        swept(spark)  # shuffles of the level before
        began = time.time()
        split = split_level(groups, vectors, top, level, learned)
        if not folder:
            groups = written(split, f"level-{level}")
            continue
        split.write.mode("overwrite").parquet(at(level))
        groups = spark.read.schema(GROUPS).parquet(at(level))
        row = (level, groups.select("group_id").distinct().count(), time.time() - began)
        spark.createDataFrame([row], "level int, groups long, seconds double").coalesce(1).write.mode("append").json(f"{folder}/timings")
    else:
        done.append(groups)
    return done[0] if len(done) == 1 else reduce(DataFrame.unionByName, done)
