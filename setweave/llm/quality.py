"""A quality classifier as a sparse ensemble of rules over text statistics.

Small trees, boosted on a bounded sample of labelled rows, give candidate rules: the conjunction of the
conditions on the way to each of their nodes. A logistic regression with an L1 penalty keeps few of them. The
rules that are left are Spark column expressions over the statistics, so scoring adds no step of its own.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from setweave.llm.frames import named, slices

STATS = ["log_words", "word_length", "upper", "digit", "space", "stop", "comma", "mark", "symbol", "bar", "high", "line_words", "repeat_next", "distinct", "top_word", "distinct_lines"]

#: Classes of bytes, each counted by its letter in the translated text.
_CLASS = bytearray(b"o" * 256)
for _chars, _kind in ((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"U"), (b"0123456789", b"D"), (b" \t\n\v\f\r", b"W"), (b".", b"S"), (b",;:", b"C"), (b"!?", b"M"), (b"#$%&*+<=>@^_`~\\/{}[]()\"'", b"Y"), (b"|", b"B"), (bytes(range(128, 256)), b"H")):
    for _c in _chars:
        _CLASS[_c] = _kind[0]
_CLASS = bytes(_CLASS)


def statistics(text: bytes) -> list[float]:
    """STATS of a whole text in UTF-8; an empty one has zeros."""
    n = len(text)
    if not n:
        return [0.0] * len(STATS)
    words = text.split()
    kinds = text.translate(_CLASS)
    share = [kinds.count(k) / n for k in (b"U", b"D", b"W", b"S", b"C", b"M", b"Y", b"B", b"H")]
    lines = [x for x in text.split(b"\n") if x]
    w = max(1, len(words))
    seen = Counter(words)
    return [
        math.log1p(len(words)), sum(map(len, words)) / w, *share, len(words) / max(1, len(lines)),
        sum(map(eq, words, words[1:])) / w, len(seen) / w, max(seen.values(), default=0) / w, len(set(lines)) / max(1, len(lines)),
    ]


def _statistics(column: int, prefix: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1000):
            rows = np.array([statistics((t or "").encode()) for t in b.column(column).to_pylist()], float).reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(rows[:, k]) for k in range(len(STATS))]], names=[*b.schema.names, *[prefix + x for x in STATS]])

    return run


def with_statistics(rows: DataFrame, text_col: str = "text", prefix: str = "s_") -> DataFrame:
    """rows with a column <prefix><name> for each of STATS of the whole text (null: empty)."""
    schema = T.StructType([*rows.schema.fields, *[T.StructField(prefix + x, T.DoubleType()) for x in STATS]])
    return rows.mapInArrow(_statistics(rows.columns.index(text_col), prefix), schema)


@dataclass
class Rules:
    """bias, and for each rule its conditions (statistic, above, threshold) and its weight."""

    bias: float = 0.0
    rules: list[tuple[list[tuple[int, bool, float]], float]] = field(default_factory=list)

    def column(self, prefix: str = "s_") -> Column:
        """The score, between 0 and 1, over the columns <prefix><name>."""
        out = F.lit(float(self.bias))
        for conditions, weight in self.rules:
            test = None
            for k, above, t in conditions:
                c = F.col(f"`{prefix}{STATS[k]}`")
                one = c > t if above else c <= t
                test = one if test is None else test & one
            out = out + F.when(test, float(weight)).otherwise(0.0)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-out))

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for conditions, weight in self.rules:
            z += weight * _holds(conditions, x)
        return 1 / (1 + np.exp(-z))


def _holds(conditions: list[tuple[int, bool, float]], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for k, above, t in conditions:
        out &= x[:, k] > t if above else x[:, k] <= t
    return out


def grow(x: np.ndarray, y: np.ndarray, trees: int, depth: int, rate: float, bins: int, least: int) -> list[list[tuple[int, bool, float]]]:
    """The conditions on the way to every node of gradient-boosted trees on the logistic loss."""
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]
    codes = np.stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(cuts)], 1)
    z = np.full(len(y), math.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    found: dict[tuple, None] = {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, p * (1 - p) + 1e-6
        step = np.zeros(len(y))
        nodes = [(np.arange(len(y)), ())]
        for level in range(depth + 1):
            after = []
            for rows, path in nodes:
                if path:
                    found.setdefault(path)
                step[rows] = g[rows].sum() / (h[rows].sum() + 1.0)
                if level == depth or len(rows) < 2 * least:
                    continue
                best = (1e-6, -1, -1)
                for k, c in enumerate(cuts):
                    if not len(c):
                        continue
                    G, H, N = (np.bincount(codes[rows, k], w, len(c) + 1).cumsum() for w in (g[rows], h[rows], None))
                    left = slice(0, len(c))
                    gain = G[left] ** 2 / (H[left] + 1) + (G[-1] - G[left]) ** 2 / (H[-1] - H[left] + 1) - G[-1] ** 2 / (H[-1] + 1)
                    gain[(N[left] < least) | (N[-1] - N[left] < least)] = 0
                    if gain.max() > best[0]:
                        best = (gain.max(), k, int(gain.argmax()))
                if best[1] >= 0:
                    _, k, t = best
                    low = codes[rows, k] <= t
                    after += [(rows[low], (*path, (k, False, float(cuts[k][t])))), (rows[~low], (*path, (k, True, float(cuts[k][t]))))]
            nodes = after
        z += rate * step
    return [list(p) for p in found]


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 24, depth: int = 3, rate: float = 0.3, bins: int = 48, least: int = 10, penalty: float = 4e-4, steps: int = 800) -> Rules:
    """Rules whose L1-penalised logistic weights on the rows (x, y) are not zero. Without rows the score is a
    half; with one label only, that of its share."""
    if not len(y):
        return Rules()
    base = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    if y.min() == y.max():
        return Rules(base)
    paths = grow(x, y, trees, depth, rate, bins, least)
    if not paths:
        return Rules(base)
    R = np.column_stack([_holds(p, x) for p in paths]).astype(float)
    keep = np.unique(R, axis=1, return_index=True)[1]
    keep.sort()
    R, paths = R[:, keep], [paths[k] for k in keep]
    mean = R.mean(0)
    Rc = R - mean
    n = len(y)
    # accelerated proximal gradient; the largest eigenvalue bounds the curvature
    L = 0.25 * np.linalg.eigvalsh(Rc.T @ Rc / n)[-1] + 0.25
    w, v, t, b, bv = np.zeros(len(paths)), np.zeros(len(paths)), 1.0, base, base
    for _ in range(steps):
        r = 1 / (1 + np.exp(-(Rc @ v + bv))) - y
        w2 = v - Rc.T @ r / n / L
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - penalty / L, 0)
        b2 = bv - r.mean() / L
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, bv = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    on = np.nonzero(np.abs(w) > 1e-6)[0]
    return Rules(float(b - (w * mean).sum()), [(paths[k], float(w[k])) for k in on])


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 12_000, **options) -> Rules:
    """Rules learned from the labelled rows of docs, from at most `sample` of them: those whose hashed ids come
    first. Null labels and ids count as none; of several labels of a document the smallest holds, and of several rows of an id
    that with the smallest statistics."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).cast("double").alias("_y"))
    known = known.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text_in")).join(F.broadcast(known), "_id")
    got = with_statistics(rows.select("_id", "_y", F.col("_text_in").cast("string").alias("_text_in")), "_text_in")
    one = got.groupBy("_id").agg(F.min(F.struct("_y", *[f"s_{x}" for x in STATS])).alias("r")).select("_id", "r.*")  # however often an id comes
    got = one.toPandas().sort_values("_id", kind="stable")
    return fit(got[[f"s_{x}" for x in STATS]].to_numpy(float), got["_y"].to_numpy(float), **options)


def with_score(docs: DataFrame, rules: Rules, *, text_col: str = "text", name: str = "score") -> DataFrame:
    """docs with the score of each whole text (null: empty), between 0 and 1, in a column of that name."""
    prefix = "s_"
    while any(c.lower().startswith(prefix) for c in [*docs.columns, name]):
        prefix = "_" + prefix
    return with_statistics(docs, text_col, prefix).select(*named(docs.columns), rules.column(prefix).alias(name))


def held_out(id_col: str, folds: int = 5, fold: int = 0) -> Column:
    """Whether a row is kept from training: by the CRC-32 of its id as text."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Rules:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return train(docs.select("doc_id", "text"), labels.where(~held_out("doc_id")))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learned from the labels outside the held-out fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rules = quality_rules(spark, docs, sf_dir)
    return with_score(docs, rules).select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
