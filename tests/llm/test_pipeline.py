"""The pipeline's stages, one after the other."""

import pytest
from messy import documents
from pyspark.sql import functions as F
from test_similar import first_of_groups

import __spark_entry__ as entry
import corpus_pipeline
from setweave.llm.frames import written

FOLDER = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, tables = docs.columns, {"in": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = tables[name] = written(stage(spark, docs, FOLDER), name)
        assert docs.columns == columns or name == "packing"
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").join(tables["in"], "doc_id")
    kept = tables["quality"].select("doc_id")
    assert labels.where("quality = 1").join(kept, "doc_id", "left_anti").count() <= 0.02 * labels.where("quality = 1").count()
    assert labels.where("quality = 0").join(kept, "doc_id").count() <= 0.1 * labels.where("quality = 0").count()
    rows = [(r["doc_id"], r["text"]) for r in tables["quality"].select("doc_id", "text").collect()]
    assert sorted(r[0] for r in tables["simhash"].select("doc_id").collect()) == first_of_groups(rows)
    assert tables["pii"].count() == tables["simhash"].count()
    assert tables["pii"].where(r"text rlike '[a-z]@[a-z0-9]+\\.[a-z]'").count() == 0
    assert tables["pii"].where("n_chars != length(text)").count() == 0
    count = lambda d: {r["doc_id"]: r["count"] for r in d.groupBy("doc_id").count().collect()}
    copies = count(tables["mixing"])
    assert set(copies) <= set(count(tables["pii"])) and max(copies.values()) == 2
    whole = tables["packing"].groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("t"))
    assert {r["doc_id"]: r["n"] // r["t"] for r in whole.collect()} == copies


def test_run(spark):
    small = "/root/testdata/sf0.001"
    assert corpus_pipeline.run(spark, small).count() > 100
    assert {"pipeline", *[f"op{n}" for n in range(1, 11)]} <= {n.split("_")[0] for n in entry.queries()}


@pytest.mark.parametrize("rows", ["messy", "none"])
def test_messy_documents(spark, rows):
    for name, stage in corpus_pipeline.STAGES:
        docs = documents(spark) if rows == "messy" else documents(spark).limit(0)
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns or name == "packing"
        assert (out.count() > 0) == (rows == "messy"), name
