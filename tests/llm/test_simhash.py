"""Fingerprints and components against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import xxhash
from messy import documents

from setweave.llm import simhash as S
from setweave.llm.components import components, forest, spanning


def plain_fingerprint(text, words=4):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not w:
        return 0
    h = [xxhash.xxh64(" ".join(w[i : i + words]).encode(), seed=42).intdigest() for i in range(max(1, len(w) - words + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(values, most):
    v = np.array(values, np.uint64)
    near = np.bitwise_count(v[:, None] ^ v[None, :]) <= most
    label = np.arange(len(v))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(v))])
        if (new == label).all():
            return label
        label = new


def test_fingerprints():
    for t in ["", " \n", "a", "a b c", "a b c d", "A b c d E", "é ü ß ñ x y", "w " * 50, "one two three four five six"]:
        assert S.fingerprint(t.encode()) == plain_fingerprint(t), t


def run_trie(values, most, batch, real=False):
    rows = list(S._spread(iter([pa.RecordBatch.from_arrays([pa.array(values.view(np.int64))], names=["fp"])])))
    table = pa.Table.from_batches(rows).sort_by([("key", "ascending"), ("guest", "ascending")])
    out = list(S._meet(most, S.DEPTH, real)(iter(table.to_batches(max_chunksize=batch))))
    return [(a, b) for x in out for a, b in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True)]


def joined(values, edges):
    at = {int(x): i for i, x in enumerate(values.view(np.int64))}
    label = list(range(len(values)))

    def find(x):
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    for a, b in edges:
        x, y = find(at[a]), find(at[b])
        label[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(values))]


def some_values():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 150, dtype=np.uint64)
    rows = [base, base[:1] ^ (np.uint64(1) << np.arange(64, dtype=np.uint64))]
    for _ in range(5):
        x = base.copy()
        for _ in range(rng.integers(1, 6)):
            x ^= np.uint64(1) << rng.integers(0, 64, len(x)).astype(np.uint64)
        rows.append(x)
    dense = base[0] ^ rng.integers(0, 1 << 9, 300, dtype=np.uint64)  # many within a few bits
    middle = base[1] ^ (rng.integers(0, 1 << 9, 200, dtype=np.uint64) << np.uint64(30)) ^ rng.integers(0, 4, 200, dtype=np.uint64)
    return np.unique(np.concatenate([*rows, dense, middle, np.array([0, 1, 3, 1 << 63], np.uint64)]))


def test_trie_join_finds_all_components(monkeypatch):
    values = some_values()
    signed = lambda x: x & ((1 << 64) - 1)
    for portion, small in ((1 << 20, 64), (200, 1)):
        monkeypatch.setattr(S, "PORTION", portion)
        monkeypatch.setattr(S, "SMALL", small)
        for most in (4, 2, 0):
            want = classes(values, most).tolist()
            assert joined(values, run_trie(values, most, 4000 if portion > 200 else 90)) == want
            real = run_trie(values, most, 4000 if portion > 200 else 90, real=True)
            assert joined(values, real) == want and all((signed(a) ^ signed(b)).bit_count() <= most for a, b in real)


def test_full_subtrees_are_taken_apart(spark):
    values = some_values()
    rows = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    loads = {r["key"]: r["n"] for r in S._loads(rows).collect()}
    spread = pa.Table.from_batches(S._spread(iter([pa.RecordBatch.from_arrays([pa.array(values.view(np.int64))], names=["fp"])])))
    assert loads == dict(zip(*np.unique(spread["key"].to_numpy(), return_counts=True), strict=True))
    for most, heavy in ((4, 100), (4, 3), (3, 20)):
        edges = [tuple(r) for r in S.links(rows, most, heavy=heavy).collect()]
        assert joined(values, edges) == classes(values, most).tolist()


def test_messy_documents(spark):
    docs = documents(spark)
    rows = docs.select("doc_id", "text").collect()
    values = [plain_fingerprint(r["text"]) for r in rows]
    label = classes(values, 4)
    want = []
    for r, v, c in zip(rows, values, label, strict=True):
        ids = [x["doc_id"] for x, y in zip(rows, label, strict=True) if y == c and x["doc_id"] is not None]
        want.append((r["doc_id"], f"{v:016x}", min(ids, default=None)))
    got = [(r["id"], r["fingerprint"], r["component_id"]) for r in S.near_duplicates(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = S.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    least = {k: min((r["doc_id"] for r, y in zip(rows, label, strict=True) if y == k and r["doc_id"] is not None), default=None) for k in set(label)}
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted(least.values(), key=str)
    assert S.near_duplicates(docs.limit(0)).count() == 0 and S.drop_near_duplicates(docs.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(5)
    for n, m in ((40, 25), (200, 190), (60, 0)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + ([(None, 1), (1, 1)] if m else [])
        edges += [(i, i + 1) for i in range(n, n + 40)] if m else []  # a long path
        edges += edges[:5]
        got = {r["vertex"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
        real = [(a, b) for a, b in edges if a is not None and a != b]
        label = {v: v for e in real for v in e}
        changed = True
        while changed:
            changed = False
            for a, b in real:
                low = min(label[a], label[b])
                if label[a] != low or label[b] != low:
                    label[a] = label[b] = low
                    changed = True
        assert got == label
        if real:
            a, b = forest(*(np.array(x) for x in zip(*real, strict=True)))
            assert dict(zip(a.tolist(), b.tolist(), strict=True)) == {v: r for v, r in label.items() if v != r}
            a, b = (np.array(x) for x in zip(*real, strict=True))
            u, v = spanning(a, b)
            assert set(zip(u.tolist(), v.tolist(), strict=True)) <= set(real) and len(u) == sum(r != k for k, r in label.items())
            assert dict(zip(*[x.tolist() for x in forest(u, v)], strict=True)) == {v: r for v, r in label.items() if v != r}
