"""The base score against brute force, the attention layer against a plain loop."""

import math
import re
import zlib
from collections import Counter
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from messy import documents
from pyspark.sql import functions as F

from setweave.llm import lm
from setweave.llm.tokens import encoder, vocabulary

PATH = vocabulary("word_bpe_49k.json")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), "\n"]


@pytest.mark.parametrize("frequent", [120_000, 40])
def test_base(spark, monkeypatch, frequent):
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    monkeypatch.setattr(lm.frequent_words, "__defaults__", (frequent,))
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    held = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2 for r in docs}
    c = Counter(t for r in docs if not held[r["doc_id"]] for t in tokens(r["text"]))
    N, V = sum(c.values()), len(c)
    got = {r["doc_id"]: r for r in lm.op8_lm(spark, folder).collect()}
    assert len(got) == len(docs)
    for r in docs:
        t, g = tokens(r["text"]), got[r["doc_id"]]
        assert (g["held_out"], g["n_tokens"], g["n_known"], g["train_tokens"]) == (held[r["doc_id"]], len(t), sum(c[w] > 0 for w in t), N)
        assert math.isclose(g["base_score"], sum(math.log10((c[w] + 1) / (N + V + 1)) for w in t), rel_tol=1e-9)
        assert math.isfinite(g["score"]) and g["score"] < 0


def sequences(n, seed=0):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):  # what follows an id mostly depends on it
        x = [int(rng.integers(0, 40))]
        for _ in range(int(rng.integers(0, 120))):
            x.append((3 * x[-1] + 1) % 40 if rng.random() < 0.8 else int(rng.integers(0, 40)))
        out.append(np.array(x, "<u4"))
    return out


def test_layer():
    train, held = sequences(200), sequences(60, 1)
    counts = np.bincount(np.concatenate(train), minlength=61).astype(float)
    counts[-1] = len(train)
    raw = model = lm.start(counts)
    for seed in range(12):
        model = replace(model, **lm.whole_pass(model, [(x, True, True) for x in train], batch=16, seed=seed)[0])
    p = lm.log10_probability(model, held)
    assert p.sum() > 0.6 * lm.log10_probability(raw, held).sum()  # it has learned what follows what
    assert np.allclose(p, lm.log10_probability(model, held, portion=1)) and np.allclose(p, np.concatenate([lm.log10_probability(model, [t]) for t in held]))
    for t, got in zip(held[:20], p, strict=False):
        T = np.concatenate([t, [len(model.row) - 1]]).astype(int)
        X = np.concatenate([[len(model.embedding) - 1], model.row[T[:-1]]])
        E = model.embedding[X].astype(float)
        q, k, v = np.split(E @ model.qkv, 3, axis=1)
        total = 0
        for i in range(len(T)):
            lo = max(0, (i // lm.BLOCK - 1) * lm.BLOCK)
            a = np.exp(k[lo : i + 1] @ q[i] * lm.WIDTH**-0.5 + model.near[i - np.arange(lo, i + 1)])
            z = (E[i] + a @ v[lo : i + 1] / a.sum()) @ model.out + model.bias
            total += (z[model.kind[T[i]]] - np.log(np.exp(z).sum())) / math.log(10) + model.share[T[i]]
        assert math.isclose(total, got, rel_tol=1e-4)
    for k in range(lm.CLASSES):  # the shares of a class add up
        if (model.kind == k).any():
            assert math.isclose((10 ** model.share[model.kind == k]).sum(), 1, rel_tol=1e-9)


def test_held_out_texts_teach_nothing(spark):
    docs = documents(spark)
    held = F.col("doc_id") % 4 == 1
    a = lm.score(docs, PATH, held).where("not held_out").orderBy("doc_id", "base_score").collect()
    other = docs.withColumn("text", F.when(held, F.lit("entirely other words")).otherwise(F.col("text")))
    b = lm.score(other, PATH, held).where("not held_out").orderBy("doc_id", "base_score").collect()
    assert [tuple(r) for r in a] == [tuple(r) for r in b]
    assert len(a) + lm.score(docs, PATH, held).where("held_out").count() == docs.count()


def test_no_rows(spark):
    docs = documents(spark)
    assert lm.score(docs.limit(0), PATH, F.lit(False)).count() == 0
    rows = lm.score(docs, PATH, F.lit(True)).collect()  # nothing to learn from
    assert len(rows) == docs.count() and all(r["n_known"] == 0 and r["train_tokens"] == 0 and r["base_score"] == 0 for r in rows)


def test_subword_counts(spark):
    rows = spark.createDataFrame([("the", 5), ("thorre.", 2), ("it's", 3), (lm.END, 4), ("é日", 1)], "word string, c long")
    enc = encoder(PATH)
    want = np.zeros(enc.size + 1)
    for w, c in rows.collect():
        for i in enc.tok.encode(w, add_special_tokens=False).ids:
            want[i] += c
    want[-1] = 4
    assert lm.subword_counts(rows, PATH).tolist() == want.tolist()


def test_spans():
    rng = np.random.default_rng(4)
    texts = [None, "", "one", "The the  THE\n", *[" ".join(f"w{k}" for k in rng.integers(0, 30, n)) for n in rng.integers(1, 3000, 60)]]
    b = pa.RecordBatch.from_arrays([pa.array(rng.integers(-(1 << 62), 1 << 62, len(texts))), pa.array(texts, pa.string())], names=["h", "text"])
    rows = [r for x in lm._spans(PATH)(iter([b.slice(0, 9), b.slice(9)])) for r in x.to_pylist()]
    plain = [[" ".join(w) for w in ([(t or "").split(" ")[k : k + lm.SPAN] for k in range(0, len((t or "").split(" ")), lm.SPAN)])] for t in texts[4:]]
    ids = {tuple(encoder(PATH).tok.encode(s, add_special_tokens=False).ids): (k, s, i == 0, i == len(spans) - 1) for k, spans in enumerate(plain) for i, s in enumerate(spans)}
    long = [r for r in rows if len(r["ids"]) > 30]
    total = sum(map(len, plain))
    assert total / lm.SHARE / 1.5 < len(long) < 1.5 * total / lm.SHARE and any(r["held"] for r in long) and any(r["last"] for r in rows)
    for r in long:
        k, s, first, last = ids[tuple(r["ids"])]
        assert (r["first"], r["last"], sum(r["n"])) == (first, last, len(r["ids"]))
        if r["held"]:
            count = Counter(texts[4 + k].split())
            assert r["words"] == s.split() and r["own"] == [count[w] for w in r["words"]]
        else:
            assert r["words"] == r["own"] == []


def test_every_word_is_in_a_span():
    """No span of a training text is left aside by a sample."""
    texts = [" ".join(f"w{k}" for k in range(n)) for n in (1, 63, 64, 65, 1000)]
    b = pa.RecordBatch.from_arrays([pa.array([11, -5, 3, 1 << 40, 9]), pa.array(texts, pa.string())], names=["h", "text"])
    rows = [r for x in lm._spans(PATH)(iter([b])) for r in x.to_pylist()]
    assert sum(len(r["n"]) for r in rows) == sum(len(t.split()) for t in texts)


def test_all_texts_teach(spark):
    counts = np.ones(encoder(PATH).size + 1)
    start = lm.start(counts)
    docs = spark.createDataFrame([(i, "one two three " * (30 if i < 40 else 9000)) for i in range(41)], "doc_id long, text string")
    words = lm.word_counts(docs.select("text"))
    train = lambda d: lm.trained(start, d, words, 30_000, PATH, part_words=1000)
    a, b = train(docs), train(docs.repartition(7))
    assert all((getattr(a, k) == getattr(b, k)).all() for k in lm.LEARNED) and a.words == b.words  # however the rows are stored
    late = [np.array(encoder(PATH).tok.encode("one two three " * 40, add_special_tokens=False).ids)]
    assert lm.log10_probability(a, late).sum() > lm.log10_probability(start, late).sum()
    assert lm.trained(start, docs.limit(0), words, 0, PATH) is start
    # every id of a part is read, those at its end as well
    flat = np.concatenate([np.zeros(4000, np.int64), np.full(8, 7)])
    p, n = lm.whole_pass(start, [(flat, False, True)])
    assert n == len(flat) and not (p["embedding"][start.row[7]] == start.embedding[start.row[7]]).all()
    assert lm.whole_pass(start, [])[1] == 0 and lm.whole_pass(start, [(flat[:3], True, True)])[1] == 4 and lm.whole_pass(start, [(flat[:1], False, False)])[1] == 0


def test_the_mass_of_all_events_is_one():
    rng = np.random.default_rng(2)
    counts = rng.integers(0, 50, 61).astype(float)  # sixty words of one id each, and the end
    model = replace(lm.start(counts), words=0.3)
    share = np.log10(rng.dirichlet(np.ones(61)))
    for prefix in ([], [3], [5] * 20, list(range(40))):
        each, last = lm.log10_each(model, np.concatenate([[*prefix, k] for k in range(60)]).astype(np.int64), np.arange(1, 61) * (len(prefix) + 1))
        words = each.reshape(60, -1)[:, -1]
        _, end = lm.log10_each(model, np.array(prefix, np.int64), np.array([len(prefix)]))
        assert math.isclose((10 ** lm.mixed(0.3, words, share[:-1])).sum() + 10 ** lm.mixed(0.3, end, share[-1])[0], 1, rel_tol=1e-5)
        # and so a text is scored
        _, whole = lm.word_scores(model, np.array(prefix, np.int64), np.array([len(prefix)]), np.ones(len(prefix), np.int64), np.zeros(len(prefix), np.int64), share[prefix], share[-1])
        parts, _ = lm.log10_each(model, np.array(prefix, np.int64), np.array([len(prefix)]))
        assert math.isclose(whole[0], lm.mixed(0.3, parts, share[prefix]).sum() + lm.mixed(0.3, end, share[-1])[0], rel_tol=1e-9)


def test_weight():
    ahead, n = np.array([1.0, -1.0, np.nan]), np.array([600.0, 300.0, 100.0])
    value = lambda w: (n * np.log10(w * np.array([10, 0.1, 0]) + 1 - w)).sum()
    w = lm.fit_weight(ahead, n)
    assert value(w) >= max(value(x) for x in np.linspace(0.02, 0.98, 49)) - 1e-2 and lm.fit_weight(ahead[:0], n[:0]) == 0


def test_rare_words_have_their_share(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 60")
    scores = []
    for frequent in (120_000, 40):
        monkeypatch.setattr(lm.frequent_words, "__defaults__", (frequent,))
        scores.append({r["doc_id"]: r["score"] for r in lm.score(docs, PATH, F.col("doc_id") % 5 == 0).collect()})
    assert scores[0].keys() == scores[1].keys()
    assert all(math.isclose(s, scores[1][i], rel_tol=1e-6) for i, s in scores[0].items())


def test_a_step_sorts_nothing_and_its_gradient_is_the_costs(monkeypatch):
    """The gradient against differences of the cross-entropy, with no sort of the positions."""
    model = lm.start(np.arange(60, 0, -1.0))
    p = {k: getattr(model, k).astype(float) for k in lm.LEARNED}
    rng = np.random.default_rng(4)
    X, Y = rng.integers(0, 60, (3, 32)), rng.integers(0, lm.CLASSES, (3, 32))

    def cost():
        gap, out = np.arange(32)[:, None] - np.arange(32), 0.0
        for x, y in zip(X, Y, strict=True):
            E = p["embedding"][x]
            Q, K, V = np.split(E @ p["qkv"], 3, axis=1)
            A = np.where(gap < 0, 0.0, np.exp(Q @ K.T * lm.WIDTH**-0.5 + p["near"][gap.clip(0)]))
            L = (E + A / A.sum(1, keepdims=True) @ V) @ p["out"] + p["bias"]
            out += (np.log(np.exp(L).sum(1)) - L[np.arange(32), y]).sum()
        return out / X.size

    with monkeypatch.context() as m:
        for name in ("argsort", "sort", "unique", "lexsort"):
            m.setattr(np, name, None)
        g = lm._gradient(p, X, Y)
    for k, a in p.items():
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in a.shape) if k != "embedding" else (X.ravel()[rng.integers(0, X.size)], rng.integers(0, lm.WIDTH))
            was, d = a[at], []
            for step in (1e-5, -1e-5):
                a[at] = was + step
                d.append(cost())
            a[at] = was
            assert math.isclose(g[k][at], (d[0] - d[1]) / 2e-5, rel_tol=1e-4, abs_tol=1e-8), (k, at)
