"""Groups by similarity of shingles against brute force."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
from messy import documents
from pyspark.sql import functions as F

import corpus_pipeline
from setweave.llm import similar as S
from setweave.llm.simhash import drop_near_duplicates, links


def plain(text, words=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def first_of_groups(rows):
    """The ids kept, by brute force: every pair compared."""
    sets = [plain(t) for _, t in rows]
    label = list(range(len(rows)))
    near = [[j for j in range(len(rows)) if 5 * len(a & sets[j]) >= 4 * len(a | sets[j])] for a in sets]
    while True:
        new = [min(label[j] for j in js) for js in near]
        if new == label:
            break
        label = new
    return sorted(min(i for (i, _), y in zip(rows, label, strict=True) if y == x) for x in set(label))


def texts(seed=3):
    rng = random.Random(seed)
    out = []
    for _ in range(40):
        w = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(60, 300))]
        out.append(" ".join(w))
        for _ in range(rng.randint(0, 4)):  # similarities on both sides of 0.8
            v = list(w)
            for _ in range(rng.randint(1, max(2, len(w) // 30))):
                v[rng.randrange(len(v))] = f"x{rng.randrange(5000)}"
            out.append(" ".join(v))
    base = [f"z{k}" for k in range(200)]
    out += [" ".join([*base[: 199 - k], f"y{k}", *base[200 - k :]]) for k in range(0, 150)]  # a large group
    return [*out, "", " \n", "one", "ONE", out[0]]


def test_stage_keeps_one_of_each_group(spark):
    rows = list(enumerate(texts()))
    a, b = next((s, t) for s in dict(rows).values() for t in dict(rows).values() if s != t and len(plain(s)) > 50 and 5 * len(plain(s) & plain(t)) >= 4 * len(plain(s) | plain(t)) and (S.fingerprint(s.encode(), 5) ^ S.fingerprint(t.encode(), 5)).bit_count() > 4)
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string").repartition(3)
    kept = corpus_pipeline.simhash(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == first_of_groups(rows)
    assert corpus_pipeline.simhash(spark, docs.where(F.col("text").isin(a, b)), "").count() == 1  # over 4 bits apart


def edited(n=120, seed=8):
    """Copies of one text with few or many edits: of any two, about as many are similar as not."""
    rng = random.Random(seed)
    base = [f"w{k}" for k in range(150)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_tiles_find_all_links():
    sets = [S.shingles(t.encode()) for t in edited()]
    pairs = lambda got: {frozenset(p) for b in got for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)}
    want = {frozenset((i, j)) for i in range(120) for j in range(i) if (n := len(np.intersect1d(sets[i], sets[j]))) * 5 >= 4 * (len(sets[i]) + len(sets[j]) - n)}
    alone = lambda edges: len({i for i in range(120)} - {i for e in edges for i in e})
    rows = [(1, 0, int(i >= 70), i, s.tobytes()) for i, s in enumerate(sets)] + [(1, 1, 0, i, s.tobytes()) for i, s in enumerate(sets) if i >= 70]
    table = pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()], strict=True)], names=["key", "tile", "side", "root", "shingles"])
    got = pairs(S._within(4, 5)(iter(table.to_batches(max_chunksize=33))))
    a, b = (np.array(x) for x in zip(*[sorted(e) for e in want], strict=True))
    u, v = (np.array(x) for x in zip(*[sorted(e) for e in got], strict=True))
    assert 0.05 < len(want) / (120 * 119 / 2) < 0.8 and alone(got) == alone(want)
    assert dict(zip(*S.forest(u, v), strict=True)) == dict(zip(*S.forest(a, b), strict=True))


def test_many_edited_copies(spark):
    rows = list(enumerate([*edited(), *edited(40, 9)]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.col("doc_id"))
    got = S.similar_groups(docs, lambda d: links(d, 4, real=True), row_col="row", tile_bytes=20_000)
    assert sorted(r[0] for r in got.groupBy("root").agg(F.min("id")).select("min(id)").collect()) == first_of_groups(rows)


def test_chain():
    rng = np.random.default_rng(0)
    rows = sorted({(int(k), int(r)) for k, r in zip(rng.integers(0, 12, 60), rng.integers(0, 50, 60), strict=True)})
    table = pa.table([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["key", "row"])
    for batch in (1000, 1, 7):
        got = [x for b in S._chain(iter(table.to_batches(max_chunksize=batch))) for x in zip(*[c.to_pylist() for c in b.columns], strict=True)]
        assert got == [(r, None, k) if i == 0 or rows[i - 1][0] != k else (r, rows[i - 1][1], None) for i, (k, r) in enumerate(rows)]


def test_messy_documents(spark):
    docs = documents(spark)
    drop = lambda d: drop_near_duplicates(d, words=5, similarity=(4, 5))
    kept = drop(docs)
    assert kept.columns == docs.columns and drop(docs.limit(0)).count() == 0
    ids = [r["doc_id"] for r in kept.collect()]
    rows = [(1 << 40 if r["doc_id"] is None else r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert sorted(1 << 40 if i is None else i for i in ids) == first_of_groups(rows)


def test_rows_of_one_id_are_told_apart(spark):
    a, b = ("one two three four five six seven", "entirely other words stand in this text")
    for options in ({}, {"words": 5, "similarity": (4, 5)}):
        kept = lambda rows, o=options: Counter(map(tuple, drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), **o).collect()))
        assert kept([(1, a), (2, a), (2, b)]) == Counter([(1, a), (2, b)])
        assert kept([(1, a), (1, a), (1, b), (None, a), (None, a + " x y"), (3, None)]) == Counter([(1, a), (1, b), (None, a + " x y"), (3, None)])
