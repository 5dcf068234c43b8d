"""The rule ensemble: held-out accuracy, and its columns against numpy."""

import numpy as np
import pytest
from messy import documents

from setweave.llm import quality as Q

FOLDER = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    rows = Q.op6_quality(spark, FOLDER)
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    assert rows.count() == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    got = rows.where("held_out").join(labels, "doc_id").select("predicted", "quality", "score").toPandas()
    assert len(got) > 200 and (got["predicted"] == got["quality"]).mean() > 0.97
    assert got["score"].between(0, 1).all()


def test_columns_say_what_the_rules_say(spark):
    rng = np.random.default_rng(0)
    x = rng.random((300, len(Q.STATS)))
    y = ((x[:, 2] > 0.4) & (x[:, 5] < 0.7)).astype(float)
    rules = Q.fit(x, y)
    assert 0 < len(rules.rules) < 120 and ((rules.scores(x) > 0.5) == y).mean() > 0.95
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], ["i"] + [f"s_{s}" for s in Q.STATS])
    got = [r["p"] for r in df.withColumn("p", rules.column()).orderBy("i").collect()]
    assert np.abs(np.array(got) - rules.scores(x)).max() < 1e-9


def test_a_larger_penalty_keeps_fewer_rules():
    rng = np.random.default_rng(0)
    x = rng.random((300, len(Q.STATS)))
    y = (x[:, 1] + 0.2 * rng.random(300) > 0.6).astype(float)
    assert len(Q.fit(x, y, penalty=0.05).rules) < len(Q.fit(x, y, penalty=1e-5).rules)


@pytest.mark.parametrize("labels", [[], [(1, 1), (2, 1)], [(1, None), (None, 0)], [(4, 1), (4, 0), (5, 1), (7, 0)]])
def test_few_labels_and_messy_documents(spark, labels):
    docs = documents(spark)
    rules = Q.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    got = Q.with_score(docs, rules, name="p")
    assert got.columns == [*docs.columns, "p"]
    rows = got.collect()
    assert len(rows) == docs.count() and all(0 <= r["p"] <= 1 for r in rows)
    assert sorted((r["doc_id"] or -1, r["text"] or "", r["s_upper"] or "") for r in rows) == sorted((r["doc_id"] or -1, r["text"] or "", r["s_upper"] or "") for r in docs.collect())
    assert Q.with_score(docs.limit(0), rules).count() == 0


def test_statistics_of_odd_texts():
    for t in (b"", b" ", b"\n\n", b"a", "é日".encode(), b"x" * 100_000, b"| | |"):
        s = Q.statistics(t)
        assert len(s) == len(Q.STATS) and all(np.isfinite(s))
