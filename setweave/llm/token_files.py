"""Token ids as ORC files: run-length coded integers, row indexes and Bloom filters on document ids.

The files hold one row per document in ascending id order: doc_id, shard (the file's place in that
order), local_start (ids before it in its shard), n_tokens and ids. Row-index minima and maxima and
the Bloom filter let a reader skip stripes and row groups by doc_id; stripes are read in parallel.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from setweave.llm.frames import scratch, slices
from setweave.llm.tokens import encoder, vocabulary

FILE_COLUMNS = "doc_id long, shard int, local_start long, n_tokens long, ids array<int>"


def _encode(path: str, end_id: int, special_as_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard, start = encoder(path, special_as_text), TaskContext.get().partitionId(), 0
        for b in slices(batches, 4000):
            at, offsets, table = enc.coded(b.column(1), end_id)
            for k in range(0, b.num_rows, 1000):
                part = b.slice(k, 1000)
                ids, ends = table.gathered(at, offsets[k : k + 1001])
                n = np.diff(ends, prepend=0)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.full(len(n), shard, np.int32)), pa.array(start + ends - n), pa.array(n), lists], names=["doc_id", "shard", "local_start", "n_tokens", "ids"])
                start += int(n.sum())

    return run


def write_token_files(docs: DataFrame, path: str, vocabulary_path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, special_as_text: bool = False, bloom_fpp: float = 0.01, bloom_columns: str = "doc_id", stripe_bytes: int = 64 << 20, row_group: int = 2000) -> None:
    """Encodes every whole text (null: empty), appends end_id and writes ORC files in ascending id order.

    Strings of special tokens become these tokens, as the library does it, or with special_as_text are ordinary text.
    A null id sorts first, equal ids by their text; repeated rows are all written. Other columns of
    docs are not read. An empty table gives a folder without rows."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    (
        rows.mapInArrow(_encode(vocabulary_path, end_id, special_as_text), FILE_COLUMNS)
        .write.option("orc.bloom.filter.columns", bloom_columns).option("orc.bloom.filter.fpp", bloom_fpp)
        .option("orc.create.index", "true").option("orc.row.index.stride", row_group).option("orc.stripe.size", stripe_bytes)
        .option("compression", "snappy").orc(path)
    )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The documents of token files as (doc_id, shard, local_start, n_tokens, ids); filters on doc_id
    reach the row indexes and Bloom filters."""
    return spark.read.schema(FILE_COLUMNS).orc(path)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = b.column(3)
        at = ids.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
        data = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<u4")).cast("B")
        crc = [zlib.crc32(data[4 * i : 4 * j]) for i, j in zip(at.tolist(), at.tolist()[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(np.diff(at)), pa.array(crc, pa.int64())], names=["doc_id", "shard", "local_start", "n_tokens", "ids_crc32"])


def document_index(files: DataFrame) -> DataFrame:
    """Per document of read_token_files: doc_id, start (ids of all documents before it), n_tokens and
    ids_crc32 (of its ids as little-endian unsigned 32-bit integers), taken from the ids as read.

    The shards' totals, one row for each written file, become offsets; they are broadcast, and their
    number is that of the partitions which wrote the files."""
    totals = files.groupBy("shard").agg(F.max(F.col("local_start") + F.col("n_tokens")).alias("n"))
    before = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    rows = files.select("doc_id", "shard", "local_start", "ids").mapInArrow(_digest, "doc_id long, shard int, local_start long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(before), "shard").select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written as ORC and read back."""
    path = scratch(spark, "token-files")
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, vocabulary("byte_bpe_50k.json"), end_id=0)
    return document_index(read_token_files(spark, path))
