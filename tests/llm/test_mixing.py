"""Targets, rounding and the reduction tree."""

from collections import defaultdict

import numpy as np
import pytest
from messy import documents
from pyspark.sql import functions as F

from setweave.llm import mixing as M


def filled(sizes, share=1.5, most=2.0):
    """Targets by resharing the excess until no source is above its limit."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, open_, out = share * sum(sizes.values()), set(order), {}
    while open_:
        level = (total - sum(out.values())) / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > most * sizes[s] + 1e-9}
        if not over:
            out |= {s: level * w[s] for s in open_}
            break
        out |= {s: most * sizes[s] for s in over}
        open_ -= over
    return out


def test_targets(spark):
    for sizes in ({"a": 100, "b": 50, "é": 10, None: 300, "z": 7}, {"a": 0, "b": 0}, {"only": 9}, {f"s{i}": (i * 37) % 91 for i in range(30)}):
        rows = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, source_size long, n long")
        got = {r["source"]: r["target"] for r in M.targets(rows).collect()}
        want = filled(sizes)
        assert got.keys() == want.keys()
        assert all(abs(got[s] - want[s]) < 1e-6 for s in want), sizes


def test_pivot():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 50, 1000):
        size, part = rng.integers(1, 500, n).astype(float), rng.uniform(0.01, 0.99, n)
        out, held = M.pivot(size, part, np.random.default_rng(1))
        left = [k for k in range(n) if 0 < out[k] < 1]
        assert left == ([held] if held >= 0 else [])
        assert abs((size * out).sum() - (size * part).sum()) < 1e-4
    hits = np.mean([M.pivot(np.array([3.0, 5.0, 2.0, 4.0]), np.array([0.3, 0.6, 0.2, 0.5]), np.random.default_rng(s))[0] for s in range(6000)], 0)
    assert np.abs(hits - [0.3, 0.6, 0.2, 0.5]).max() < 0.03  # no expectation changes


@pytest.mark.parametrize("block,fan", [(4096, 4096), (16, 3)])
def test_sources_come_near_their_targets(spark, block, fan):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 1, F.lit(None)).otherwise(F.concat(F.lit("s"), (F.col("id") % 5).cast("string"))).alias("source"), F.repeat(F.lit("w "), (F.pmod(F.xxhash64("id"), F.lit(60)) + (F.col("id") % 11 != 0).cast("int") - 1).cast("int")).alias("text"), F.col("id").alias("_row"))
    got = M.mix(rows, row_col="_row", block=block, fan=fan).collect()
    assert len(got) == 3000 and {r["copies"] for r in got} <= {0, 1, 2}
    sums, target, size = defaultdict(int), {}, defaultdict(int)
    for r in got:
        sums[r["source"]] += r["copies"] * r["size"]
        size[r["source"]] += r["size"]
        target[r["source"]] = r["target"]
    want = filled(dict(size))
    for s in size:
        assert abs(target[s] - want[s]) < 1e-6 and abs(sums[s] - target[s]) <= 60, s
    again = M.mix(rows.repartition(7), row_col="_row", block=block, fan=fan).collect()
    assert sorted((r["row"], r["copies"]) for r in got) == sorted((r["row"], r["copies"]) for r in again)


def test_messy_documents(spark):
    docs = documents(spark)
    taken = M.take_copies(docs)
    assert taken.columns == docs.columns
    sizes = {len((r["text"] or "").split()) for r in docs.collect()}
    assert {len((r["text"] or "").split()) for r in taken.collect()} <= sizes - {0}
    assert M.take_copies(docs.limit(0)).count() == 0
    none = docs.where("text is null")
    assert M.mix(none.withColumn("r", F.lit(1)), row_col="r").collect()[0]["copies"] == 0
