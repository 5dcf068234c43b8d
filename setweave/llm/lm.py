"""Language-model scores: an add-one unigram base over all training words, and a causal self-attention model.

The model reads subword ids and mixes two experts event by event, an event being a word or the end of the text: the attention
layer's probability of the event's ids, and the event's share of all training tokens, joined where the word is not one of the
frequent ones. Both give all events together a probability of one at most, and so does the mixture.

The first is a single attention layer over the ids before a position that gives the next id's class; within its class an id has
its share of the counts of all training texts. A text is cut into blocks; the positions of a block attend to what lies before
them in it and to the whole block before, so windows overlap by a block and every id is scored once. All blocks of a
batch go through the layer together.

The layer is trained in numpy on spans of words, all those of all training texts but for one in HELD, which is left out of
training; on those the experts' weight is fitted. SHARE above 1 would take one span in so many.
"""

from __future__ import annotations

import math
import pickle
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from setweave.llm.frames import slices, written
from setweave.llm.tokens import cut_words, encoder, vocabulary

#: The end of a text, as a token; no word holds a white space.
END = "\n"
#: Positions of a block, width, classes, ids with an embedding of their own.
BLOCK, WIDTH, CLASSES, OWN = 16, 16, 48, 2000
#: Words whose counts every worker holds, at most; the counts of all others are joined.
FREQUENT = 120_000
#: Words of the spans that one task trains on, about.
PART_WORDS = 1 << 21
#: Words of a span; of how many spans one is trained on; of how many of these one is held for the weight. Powers of two.
SPAN, SHARE, HELD = 64, 1, 8


@dataclass
class Model:
    """Arrays of the trained layer. row: embedding of an id; kind: its class; share: log10 of its share of its class. The
    last id is the end of a text; the last embedding is the start's."""

    row: np.ndarray
    kind: np.ndarray
    share: np.ndarray
    embedding: np.ndarray
    qkv: np.ndarray
    near: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    words: float = 0.0  # the weight of the expert on words' shares


def classes(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, kind, share) of the ids from their counts, the end last: the most frequent ids are classes of their own, the
    others fill the rest of the classes with about equal counts."""
    n = len(counts)
    order = np.argsort(-counts[:-1], kind="stable")
    kind, row = np.zeros(n, np.int64), np.zeros(n, np.int64)
    alone = CLASSES * 3 // 4
    kind[order[:alone]] = np.arange(min(alone, n - 1))
    rest = order[alone:]
    mass = np.cumsum(counts[rest] + 1.0)
    kind[rest] = alone + np.minimum((mass - 1) / (mass[-1] if len(mass) else 1) * (CLASSES - alone - 1), CLASSES - alone - 2).astype(np.int64)
    kind[-1] = CLASSES - 1
    row[order] = np.where(np.arange(n - 1) < OWN, np.arange(n - 1), OWN + kind[order])
    row[-1] = OWN + CLASSES - 1
    total = np.bincount(kind, counts + 1.0, CLASSES)
    return row, kind, np.log10((counts + 1.0) / total[kind])


def _steps() -> np.ndarray:
    """How far key j of a block and the one before it lies behind query i; negative: after it."""
    return np.arange(BLOCK)[:, None] + BLOCK - np.arange(2 * BLOCK)


def _sequences(texts: list[tuple[np.ndarray, bool, bool]], row: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The inputs and classes of the positions of parts of texts (ids, first, last), one after the other. The first part of
    a text begins with the start; another's first id is only read; the last part ends with the end."""
    x, y = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    for ids, first, last in texts:
        t = np.concatenate([ids, [len(row) - 1]]).astype(np.int64) if last else ids.astype(np.int64)
        x.append(np.concatenate([[OWN + CLASSES], row[t[:-1]]] if first else [row[t[:-1]]]).astype(np.int32))
        y.append(kind[t if first else t[1:]].astype(np.int32))
    return np.concatenate(x), np.concatenate(y)


def _rows(a: np.ndarray) -> np.ndarray:
    """The sums of a matrix's rows, as a product: numpy adds up short rows one by one."""
    return a @ np.ones(a.shape[1], a.dtype)


def _gradient(p: dict[str, np.ndarray], X: np.ndarray, Y: np.ndarray) -> dict[str, np.ndarray]:
    """The gradient of the mean cross-entropy over windows of inputs X and classes Y. Scores are held within 60, as when texts
    are scored."""
    (B, T), real = X.shape, p["out"].dtype.type
    gap = np.arange(T)[:, None] - np.arange(T)
    scale, past = real(WIDTH**-0.5), gap.clip(0)
    parts = lambda a: (a[:, :, :WIDTH], a[:, :, WIDTH : 2 * WIDTH], a[:, :, 2 * WIDTH :])
    E = p["embedding"].take(X.ravel(), 0)
    QKV = E @ p["qkv"]
    QKV[:, :WIDTH] *= scale
    Q, K, V = parts(QKV.reshape(B, T, -1))
    A = Q @ K.transpose(0, 2, 1)
    A += p["near"][past]
    np.clip(A, -60, 60, out=A)
    np.exp(A, out=A)
    A *= (gap >= 0).astype(real)
    A *= (1 / _rows(A.reshape(-1, T))).reshape(B, T, 1)
    O = (A @ V).reshape(-1, WIDTH)
    H = E + O
    D = H @ p["out"]
    D += p["bias"]
    np.clip(D, -60, 60, out=D)
    np.exp(D, out=D)
    D *= (real(1 / (B * T)) / _rows(D))[:, None]
    D[np.arange(B * T), Y.ravel()] -= real(1 / (B * T))
    g = {"out": H.T @ D, "bias": np.ones(B * T, real) @ D}
    dH = D @ p["out"].T
    each = dH.reshape(B, T, WIDTH)
    dS = each @ V.transpose(0, 2, 1)
    dS -= _rows(dH * O).reshape(B, T, 1)
    dS *= A
    g["near"] = np.bincount(past.ravel(), np.ones(B, real) @ dS.reshape(B, -1), T).astype(real)
    dQKV = np.empty((B, T, 3 * WIDTH), real)
    for at, x, y in zip(parts(dQKV), (dS, dS.transpose(0, 2, 1), A.transpose(0, 2, 1)), (K, Q, each), strict=True):
        np.matmul(x, y, out=at)
    dQKV[:, :, :WIDTH] *= scale
    dQKV = dQKV.reshape(-1, 3 * WIDTH)
    g["qkv"] = E.T @ dQKV
    dH += dQKV @ p["qkv"].T
    cells = X.reshape(-1, 1) * WIDTH + np.arange(WIDTH)
    g["embedding"] = np.bincount(cells.ravel(), dH.ravel(), p["embedding"].size).astype(real).reshape(-1, WIDTH)
    return g


def _adam(p: dict[str, np.ndarray], batches: Iterator[tuple[np.ndarray, np.ndarray]], steps: int, rate: float) -> None:
    """Adam steps over the batches, the rate falling to none."""
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    for step, (X, Y) in enumerate(batches, 1):
        g = _gradient(p, X, Y)
        for k, a in p.items():
            d = g[k]
            m[k] *= 0.9
            m[k] += 0.1 * d
            d *= d
            d *= 0.01
            v[k] *= 0.99
            v[k] += d
            np.sqrt(v[k], out=d)
            d *= (1 - 0.99**step) ** -0.5
            d += 1e-8
            np.divide(m[k], d, out=d)
            d *= rate * (1 - step / (steps + 1)) / (1 - 0.9**step)
            a -= d


def start(counts: np.ndarray, seed: int = 8) -> Model:
    """The layer before any training: random but for the bias, which gives the classes their shares of the counts."""
    row, kind, share = classes(counts)
    rng = np.random.default_rng(seed)
    p = {"embedding": rng.normal(0, 0.3, (OWN + CLASSES + 1, WIDTH)), "qkv": rng.normal(0, WIDTH**-0.5, (WIDTH, 3 * WIDTH)), "near": np.zeros(2 * BLOCK), "out": rng.normal(0, 0.1, (WIDTH, CLASSES)), "bias": np.log((np.bincount(kind, counts + 1.0, CLASSES) + 1.0) / (counts.sum() + len(counts) + CLASSES))}
    p["bias"] -= p["bias"].max()
    f = {k: a.astype(np.float32) for k, a in p.items()}
    return Model(row.astype(np.int32), kind.astype(np.int32), share, **f)


#: The arrays of a model that are learned.
LEARNED = ("embedding", "qkv", "near", "out", "bias")


def whole_pass(model: Model, texts: list[tuple[np.ndarray, bool, bool]], batch: int = 64, rate: float = 0.01, seed: int = 8) -> tuple[dict[str, np.ndarray], int]:
    """The learned arrays after one pass from the model's over all windows of the parts of texts (ids, first, last), and how
    many ids it read: every id is in a window, the windows in random order."""
    T = 2 * BLOCK
    p = {k: getattr(model, k).astype(np.float32) for k in LEARNED}
    x, y = _sequences(texts, model.row, model.kind)
    n = len(x)
    if 0 < n < T:  # the only window repeats its last position
        x, y = (np.pad(a, (0, T - n), mode="edge") for a in (x, y))
    begin = np.unique(np.minimum(np.arange(0, len(x), T), max(len(x) - T, 0)))
    begin = np.random.default_rng(seed).permutation(begin) if n else begin[:0]
    steps = -(-len(begin) // batch)
    at = (begin[k * batch : (k + 1) * batch, None] + np.arange(T) for k in range(steps))
    _adam(p, ((x[k], y[k]) for k in at), steps, rate)
    return p, n


SPANS = "key long, held boolean, first boolean, last boolean, ids array<int>, n array<int>, words array<string>, own array<int>"


def _spans(path: str):
    """From (h, text), h a hash of the row, one in SHARE of the spans of each text, chosen by h and the span's number: its ids,
    how many each word has, and for held spans the words and how often each stands in its whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in slices(batches):
            at, offsets, distinct = cut_words(b.column(1), lower=True)
            size = np.diff(offsets)
            spans = np.maximum(-(-size // SPAN), 1)
            text = np.repeat(np.arange(b.num_rows), spans)
            s = np.arange(len(text)) - np.repeat(np.cumsum(spans) - spans, spans)
            key = (b.column(0).to_numpy().view(np.uint64)[text] + s.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(32)
            on = np.flatnonzero(key % np.uint64(SHARE) == 0)
            text, s, key = text[on], s[on], key[on]
            lo = offsets[text] + s * SPAN
            n = np.minimum(lo + SPAN, offsets[text + 1]) - lo
            ends = np.cumsum(n)
            entry = np.repeat(lo - (ends - n), n) + np.arange(int(n.sum()))
            many = np.bincount(at[entry], minlength=len(distinct))
            used = np.flatnonzero(many)
            where = (np.cumsum(many > 0) - 1)[at[entry]]
            names = distinct.take(pa.array(used))
            table = enc.lookup(names.to_pylist(), many[used])
            cuts = np.concatenate([[0], ends])
            ids, stops = table.gathered(where, cuts)
            held = key // np.uint64(SHARE) % np.uint64(HELD) == 0
            m = np.where(held, n, 0)
            kept = np.repeat(held, n)
            # how often the words of held spans stand in their whole texts
            pair = np.repeat(text, n)[kept] * len(distinct) + at[entry[kept]]
            of = np.repeat(np.arange(b.num_rows), size)
            some = np.zeros(b.num_rows, bool)
            some[text[held]] = True
            mine = some[of]
            pairs, times = np.unique(of[mine] * len(distinct) + at[offsets[0] : offsets[-1]][mine], return_counts=True)
            own = times[np.searchsorted(pairs, pair)] if len(pair) else np.zeros(0, np.int64)
            lists = lambda ends, values: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), values)
            cols = [pa.array(key.view(np.int64)), pa.array(held), pa.array(s == 0), pa.array(lo + n == offsets[text + 1]), lists(stops, pa.array(ids.astype(np.int32))), lists(ends, pa.array(table.n[where].astype(np.int32)))]
            cols += [lists(np.cumsum(m), names.take(pa.array(where[kept]))), lists(np.cumsum(m), pa.array(own.astype(np.int32)))]
            yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in SPANS.split(", ")])

    return run


PASSES = "part long, ids long, learned binary, words array<string>, own array<int>, layer array<double>"


def _pass(shared: Broadcast):
    def run(table: pa.Table) -> pa.Table:
        part, model = table.column("part")[0].as_py(), pickle.loads(shared.value)
        table = table.sort_by("key").combine_chunks()
        value = lambda c: table.column(c).chunk(0)
        held, first, last = (value(c).to_numpy(zero_copy_only=False) for c in ("held", "first", "last"))
        at, every = value("ids").offsets.to_numpy(), value("ids").values.to_numpy()
        arrays = [every[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        p, n = whole_pass(model, [(arrays[k], first[k], last[k]) for k in np.flatnonzero(~held).tolist()])
        kept = [arrays[k] for k in np.flatnonzero(held).tolist()]
        each, _ = log10_each(replace(model, **p), np.concatenate([np.zeros(0, np.int32), *kept]), np.cumsum([len(x) for x in kept], dtype=np.int64))
        on = table.filter(pa.array(held))
        many = pc.list_flatten(on.column("n")).to_numpy().astype(np.int64)
        layer, real = _summed(each, many), many > 0
        words, own = (pc.list_flatten(on.column(c)).combine_chunks().filter(pa.array(real)) for c in ("words", "own"))
        one = lambda v: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v)
        return pa.table([pa.array([part], pa.int64()), pa.array([n], pa.int64()), pa.array([pickle.dumps(p)], pa.binary()), one(words), one(own), one(pa.array(layer[real], pa.float64()))], names=[x.split()[0] for x in PASSES.split(", ")])

    return run


def trained(model: Model, learned: DataFrame, counts: DataFrame, words: int, path: str, part_words: int | None = None) -> Model:
    """The model after a pass over the chosen spans of every text of (doc_id, text), which have so many words in all and whose
    counts are (word, c). The spans are dealt over parts, as many as the words ask for; each part goes on from the model over all
    its windows, and the parts' arrays are averaged by the ids they have read. The same rows give the same model, however
    they are stored. Without texts it stays as it is."""
    spark, parts = learned.sparkSession, max(1, -(-words // SHARE // (part_words or PART_WORDS)))
    shared = spark.sparkContext.broadcast(pickle.dumps(model))  # its size is that of the vocabulary
    spans = learned.select(F.xxhash64("doc_id", "text").alias("h"), "text").mapInArrow(_spans(path), SPANS)
    dealt = spans.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("long"))
    passed = written(dealt.groupBy("part").applyInArrow(_pass(shared), PASSES), "passes")
    total, read = {k: np.zeros(getattr(model, k).shape) for k in LEARNED}, 0
    for r in passed.select("part", "ids", "learned").orderBy("part").toLocalIterator():
        for k, a in pickle.loads(r["learned"]).items():
            total[k] += r["ids"] * a.astype(float)
        read += r["ids"]
    if not read:
        return model
    seen = passed.select(F.explode(F.arrays_zip("words", "own", "layer")).alias("o")).select("o.*")
    share = F.col("c") - F.col("own")  # without the text itself: what a text that is not learned from would see
    ahead = F.when(share > 0, F.round((F.log10(share / words) - F.col("layer")) * BINS)).cast("long")
    found = seen.join(counts.withColumnRenamed("word", "words"), "words").groupBy(ahead.alias("ahead")).count().toPandas()  # a row for each step
    return replace(model, words=fit_weight(found["ahead"].to_numpy(float) / BINS, found["count"].to_numpy(float)), **{k: (a / read).astype(np.float32) for k, a in total.items()})


def log10_probability(model: Model, texts: list[np.ndarray], portion: int = 512) -> np.ndarray:
    """The log10 probability of each id sequence and its end, by the attention layer alone."""
    ids = np.concatenate([*texts, np.zeros(0, np.uint32)])
    stops = np.cumsum([len(t) for t in texts]) if texts else np.zeros(0, np.int64)
    inner, last = log10_each(model, ids, stops, portion)
    return np.diff(np.concatenate([[0.0], np.cumsum(inner)])[np.concatenate([[0], stops])]) + last


def log10_each(model: Model, ids: np.ndarray, stops: np.ndarray, portion: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """The log10 probability of each id after those before it in its text, and of each text's end. Texts follow one another
    in ids and end at stops. Longer batches go in portions of blocks, each with the block before it, so memory does not grow
    with a text."""
    if not len(stops):
        return np.zeros(0), np.zeros(0)
    n = np.diff(stops, prepend=0) + 1
    padded = -(-n // BLOCK) * BLOCK
    begin = np.cumsum(padded) - padded
    size = int(padded.sum())
    target = np.full(size, -1, np.int32)
    inner = np.ones(size, bool)
    inner[begin + n - 1] = False
    pad = np.arange(size) - np.repeat(begin, padded) >= np.repeat(n, padded)
    inner &= ~pad
    target[inner] = ids
    target[begin + n - 1] = len(model.row) - 1
    source = np.full(size, len(model.embedding) - 1, np.int32)
    source[1:] = np.where(target[:-1] >= 0, model.row[np.maximum(target[:-1], 0)], len(model.embedding) - 1)
    source[begin] = len(model.embedding) - 1
    opens = np.zeros(size // BLOCK, bool)
    opens[begin // BLOCK] = True
    step = _steps()
    near = np.where(step < 0, np.float32(-1e9), model.near[np.clip(step, 0, len(model.near) - 1)])
    scale = np.float32(WIDTH**-0.5)
    logp = np.zeros(size)
    for b in range(0, len(opens), portion):
        e = min(b + portion, len(opens))
        lo = max(b - 1, 0)
        E = model.embedding.take(source[lo * BLOCK : e * BLOCK], 0)
        qkv = (E @ model.qkv).reshape(e - lo, BLOCK, 3 * WIDTH)
        skip = b - lo
        Q = qkv[skip:, :, :WIDTH] * scale
        KV = qkv[:, :, WIDTH:]
        before = KV[:-1] if skip else np.concatenate([KV[:1], KV[:-1]])  # the first text's first block sees none
        both = np.concatenate([before, KV[skip:]], 1)
        S = Q @ both[:, :, :WIDTH].transpose(0, 2, 1)
        S += near
        S[opens[b:e], :, :BLOCK] = -1e9
        np.minimum(S, 60, out=S)
        np.exp(S, out=S)
        O = S @ both[:, :, WIDTH:]
        O /= _rows(S.reshape(-1, 2 * BLOCK)).reshape(-1, BLOCK, 1)
        H = E[skip * BLOCK :] + O.reshape(-1, WIDTH)
        L = H @ model.out
        L += model.bias
        np.clip(L, -60, 60, out=L)
        t = target[b * BLOCK : e * BLOCK]
        hit = L[np.arange(len(t)), model.kind[np.maximum(t, 0)]]
        np.exp(L, out=L)
        logp[b * BLOCK : e * BLOCK] = np.where(t >= 0, (hit - np.log(_rows(L))) / np.float32(math.log(10)) + model.share[np.maximum(t, 0)], 0.0)
    return logp[inner], logp[begin + n - 1]


def _summed(each: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The sums of runs of n values each, which no other run's values can change by rounding."""
    return np.bincount(np.repeat(np.arange(len(n)), n), each, len(n))


def mixed(weight: float, layer: np.ndarray, share: np.ndarray | float) -> np.ndarray:
    """The log10 probability of events by both experts, from that of each; weight is that of the share."""
    return layer if weight <= 0 else np.logaddexp(math.log(1 - weight) + layer * math.log(10), math.log(weight) + np.multiply(share, math.log(10))) / math.log(10)


def word_scores(model: Model, ids: np.ndarray, stops: np.ndarray, n: np.ndarray, text: np.ndarray, share: np.ndarray, end: float) -> tuple[np.ndarray, np.ndarray]:
    """For words of n ids each, the log10 probability by the layer, and that of each text, its end included, by both experts.
    text: each word's text; share: log10 of a word's share of the training tokens, -inf if it is not a frequent one; end:
    that of the end."""
    each, last = log10_each(model, ids, stops)
    layer = _summed(each, n)
    return layer, np.bincount(text, np.where(n > 0, mixed(model.words, layer, share), 0.0), len(stops)) + mixed(model.words, last, end)


#: Steps of a power of ten in which the words of held spans are counted.
BINS = 20


def fit_weight(ahead: np.ndarray, n: np.ndarray, steps: int = 50) -> float:
    """The weight of the expert on shares, by expectation maximisation over n words each, whose share is so many powers of ten
    ahead of the layer's probability (nan: no share)."""
    weight, odds = 0.5, 10 ** np.minimum(np.nan_to_num(ahead, nan=-300.0), 300.0)
    for _ in range(steps if n.sum() else 0):
        weight = float(np.clip((n * weight * odds / (weight * odds + 1 - weight)).sum() / n.sum(), 0.01, 0.99))
    return weight if n.sum() else 0.0


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 5000):
        at, _, words = cut_words(b.column(0), lower=True)
        n = pa.array(np.bincount(at, minlength=len(words)), pa.int64())
        real = pc.not_equal(words, "")
        yield pa.RecordBatch.from_arrays([words.filter(real), n.filter(real)], names=["word", "c"])
        yield pa.RecordBatch.from_arrays([pa.array([END]), pa.array([b.num_rows], pa.int64())], names=["word", "c"])


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) of all whole texts in the only column (null: empty): A-Z lower-cased, and END once a text."""
    return texts.mapInArrow(_count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _subwords(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        total = np.zeros(enc.size + 1, np.int64)
        for b in slices(batches, 50_000):
            words, c = b.column(0).to_pylist(), b.column(1).to_numpy()
            for at, ids, n in enc.once(words):
                np.add.at(total, ids, np.repeat(c[at], n))
            total[-1] += c[[w == END for w in words]].sum()
        on = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(on.astype(np.int64)), pa.array(total[on])], names=["id", "c"])

    return run


def frequent_words(counts: DataFrame, most: int = FREQUENT) -> pd.DataFrame:
    """The most frequent words, END aside, and their counts: `most` rows at most, all those above some count."""
    words = counts.where(F.col("word") != END)
    rank = F.floor(F.log2("c") * 32).cast("int")
    sizes = words.groupBy(rank.alias("rank")).count().orderBy(F.desc("rank")).collect()  # a row for each step of a count
    least, total = 1 << 30, 0
    for r in sizes:
        total += r["count"]
        if total > most:
            break
        least = r["rank"]
    return words.where(rank >= least).toPandas()


def subword_counts(counts: DataFrame, path: str) -> np.ndarray:
    """How often each id of the vocabulary, and last the end, stands in the counted words. One row for each id at most
    reaches the driver, whatever the number of words."""
    got = counts.mapInArrow(_subwords(path), "id long, c long").groupBy("id").agg(F.sum("c").alias("c")).toPandas()
    out = np.zeros(encoder(path).size + 1)
    out[got["id"].to_numpy(np.int64)] = got["c"]
    return out


_held: dict[str, tuple] = {}


def _unpacked(shared: Broadcast, key: str) -> tuple:
    if key not in _held:
        _held.clear()
        words, c, total, end, model = pickle.loads(shared.value)
        share = np.concatenate([[-np.inf], np.log10(np.maximum(c, 1) / max(total, 1))])
        _held[key] = ({w: i for i, w in enumerate(words, 1)} | {"": 0}, np.concatenate([[0.0], np.log10(c + 1.0)]), share, end, model)
    return _held[key]


SCORED = "rid long, doc_id long, held_out boolean, n_tokens long, n_frequent long, base_frequent double, score double, rare array<struct<word:string,n:long,layer:array<double>>>"


def _score(shared: Broadcast, key: str, path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, rid = encoder(path), TaskContext.get().partitionId() << 40
        index, logc, share, end, model = _unpacked(shared, key)
        for b in slices(batches, 2000):
            at, offsets, distinct = cut_words(b.column(2), lower=True)
            words = distinct.to_pylist()
            table = enc.lookup(words, np.bincount(at, minlength=len(words)))
            ids, stops = table.gathered(at, offsets)
            of = np.array([index.get(w, -1) for w in words], np.int64)
            real = of[at]
            text = np.repeat(np.arange(b.num_rows), np.diff(offsets))
            n_tokens = np.bincount(text, real != 0, b.num_rows).astype(np.int64)
            known = np.bincount(text, real > 0, b.num_rows).astype(np.int64)
            base = np.bincount(text, logc[np.maximum(real, 0)], b.num_rows)
            layer, scores = word_scores(model, ids, stops, table.n[at], text, share[np.maximum(real, 0)], end)
            low = np.flatnonzero(real < 0)
            pair = text[low] * len(words) + at[low]
            pairs, times = np.unique(pair, return_counts=True)
            layer = np.where(table.n[at] > 0, layer, 300.0)  # a word without ids has no part in the score
            each = layer[low][np.argsort(pair, kind="stable")]
            each = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(times)]).astype(np.int32)), pa.array(each, pa.float64()))
            names = distinct.take(pa.array(pairs % len(words)))
            cuts = np.concatenate([[0], np.cumsum(np.bincount(pairs // len(words), minlength=b.num_rows))])
            rare = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.StructArray.from_arrays([names, pa.array(times, pa.int64()), each], ["word", "n", "layer"]))
            cols = [pa.array(np.arange(rid, rid + b.num_rows)), b.column(0), b.column(1), pa.array(n_tokens), pa.array(known), pa.array(base), pa.array(scores), rare]
            rid += b.num_rows
            yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in SCORED.split(", ", 7)])

    return run


def score(docs: DataFrame, vocabulary_path: str, held_out: Column, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every whole text (null: empty).

    Rows for which held_out is true are scored but never learned from; a null there counts as false. The base's counts and
    the model's shares cover all other rows; the layer is trained on spans of all of them (see trained). The most frequent
    words' counts are held by every worker (FREQUENT of them at most); those of all others are joined, so any vocabulary
    fits, and every word that was learned has its share whatever its number. Rows of equal id are all scored, equal texts alike;
    other columns are not read; an empty table gives no rows."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    learned = rows.where("not held_out")
    counts = written(word_counts(learned.select("text")), "word-counts")
    N, V = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    frequent = frequent_words(counts)
    ends = (counts.where(F.col("word") == END).first() or (END, 0))[1]
    model = trained(start(subword_counts(counts, vocabulary_path)), learned.select("doc_id", "text"), counts, N, vocabulary_path)
    end = math.log10(ends / N) if ends else -math.inf
    shared, key = spark.sparkContext.broadcast(pickle.dumps((frequent["word"].tolist(), frequent["c"].to_numpy(float), N, end, model))), uuid.uuid4().hex
    scored = written(rows.mapInArrow(_score(shared, key, vocabulary_path), SCORED), "scored")
    rare = scored.select("rid", F.explode("rare").alias("r")).select("rid", "r.word", "r.n", "r.layer")
    gain = F.lit(0.0)
    if 0 < model.words < 1 and N:  # _score has mixed rare words with no share; what their own adds, log10(1 + 10^t)
        odds = F.log10(F.col("c") / N) + math.log10(model.words / (1 - model.words))
        more = lambda t: F.greatest(t, F.lit(0.0)) + F.log10(1 + F.pow(F.lit(10.0), -F.abs(t)))
        gain = F.when(F.col("c") > 0, F.aggregate("layer", F.lit(0.0), lambda a, x: a + more(odds - x))).otherwise(0.0)
    rare = rare.join(counts, "word", "left").groupBy("rid").agg(F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 1.0)).alias("base"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("known"), F.sum(gain).alias("gain"))
    out = scored.drop("rare").join(rare, "rid", "left")
    each = math.log10(N + V + 1)
    n_tokens = F.col("n_tokens") + 1
    base = F.col("base_frequent") + F.coalesce("base", F.lit(0.0)) + math.log10(ends + 1) - n_tokens * F.lit(each)
    known = F.col("n_frequent") + F.coalesce("known", F.lit(0)) + int(ends > 0)
    return out.select("doc_id", "held_out", n_tokens.alias("n_tokens"), known.cast("long").alias("n_known"), F.lit(N).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("score") + F.coalesce("gain", F.lit(0.0))).alias("score"))


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learned from those outside the held-out fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, vocabulary("word_bpe_49k.json"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2)
