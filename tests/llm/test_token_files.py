"""Token files: an exact round trip."""

import zlib

import numpy as np
import pyarrow.orc as orc
import pytest
from messy import documents
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from setweave.llm import token_files as T
from setweave.llm.tokens import encoder, vocabulary

PATH = vocabulary("byte_bpe_50k.json")


@pytest.mark.parametrize("partitions", [1, 3])
def test_round_trip(spark, tmp_path, partitions):
    docs = documents(spark).repartition(partitions)
    path = f"file://{tmp_path}/ids"
    T.write_token_files(docs, path, PATH)
    files = T.read_token_files(spark, path)
    enc = encoder(PATH).tok
    rows = sorted([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start, want = 0, []
    for d, t in rows:
        ids = [*enc.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = sorted(map(tuple, T.document_index(files).collect()), key=lambda r: r[1])
    assert got == want
    assert files.where("doc_id = 9").count() == 1 and files.where("doc_id = 999").count() == 0


def test_file_format(spark, tmp_path):
    T.write_token_files(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), f"file://{tmp_path}/ids", PATH)
    seen = []
    for f in sorted((tmp_path / "ids").glob("part-*.orc")):
        file = orc.ORCFile(f)
        assert file.row_index_stride == 2000
        seen += file.read(columns=["doc_id"])["doc_id"].to_pylist()
    assert seen == sorted(seen) and len(seen) == 200


def test_filters_skip_row_groups(spark, tmp_path):
    docs = spark.range(0, 20_000, 2).select(F.col("id").alias("doc_id"), F.lit("a <|endoftext|> b").alias("text")).coalesce(1)
    spark_one = docs.sparkSession
    scanned = {}
    for bloom in (0.01, None):
        path = f"file://{tmp_path}/ids-{bloom}"
        T.write_token_files(docs, path, PATH, bloom_fpp=bloom or 0.01, bloom_columns="doc_id" if bloom else "")
        for wanted in (4001, 4002, 1_000_000):
            df = T.read_token_files(spark_one, path).where(f"doc_id = {wanted}")
            assert len(df.collect()) == (wanted == 4002)
            plan = df._jdf.queryExecution().executedPlan()
            scanned[bloom, wanted] = plan.collectLeaves().apply(0).metrics().apply("numOutputRows").value()
    assert scanned[0.01, 1_000_000] == scanned[None, 1_000_000] == 0  # by the least and largest ids
    assert 0 < scanned[None, 4001] <= 2000 and 0 < scanned[0.01, 4002] <= 2000  # one row group of 10,000 rows
    assert scanned[0.01, 4001] == 0  # by the Bloom filter
    (row,) = T.read_token_files(spark, f"file://{tmp_path}/ids-0.01").where("doc_id = 0").collect()
    assert row["ids"] == [*Tokenizer.from_file(PATH).encode("a <|endoftext|> b", add_special_tokens=False).ids, 0] and 50256 in row["ids"]


def test_no_rows(spark, tmp_path):
    T.write_token_files(documents(spark).limit(0), f"file://{tmp_path}/ids", PATH)
    assert T.document_index(T.read_token_files(spark, f"file://{tmp_path}/ids")).count() == 0
