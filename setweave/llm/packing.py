"""Packing documents into training sequences: vector bin packing by the dot-product heuristic.

Every sequence holds at most so many tokens, segments and loss-bearing tokens at once. An open
sequence takes, of the pieces that fit, the one whose demand has the largest dot product with what
the sequence has left, each limit weighted by how scarce it is; when none fits, a new one opens.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from setweave.llm.frames import free, slices, written
from setweave.llm.tokens import encoder, vocabulary

#: Pieces that are packed together in one task; each such block ends with at most a few part-filled sequences.
BLOCK_PIECES = 16_384
PIECES = "doc_id long, piece_row long, start long, length long, ids_crc32 long, doc_tokens long, loss long"


def place(length: np.ndarray, loss: np.ndarray, tokens: int, segments: int, loss_tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """The sequence and the offset of each piece, by the dot-product heuristic over equal pieces together.

    A piece that exceeds a limit by itself is an error: cut() makes none."""
    if len(length) and (length.max() > tokens or loss.max() > loss_tokens):
        raise ValueError("a piece exceeds a limit by itself")
    kinds, of = np.unique(np.stack([length, loss], 1), axis=0, return_inverse=True)
    of = of.reshape(-1)
    members = np.split(np.argsort(of, kind="stable"), np.cumsum(np.bincount(of, minlength=len(kinds)))[:-1])
    left = np.array([len(m) for m in members])
    limit = np.array([tokens, segments, loss_tokens], float)
    demand = np.column_stack([kinds, np.ones(len(kinds), int)])[:, [0, 2, 1]] if len(kinds) else np.zeros((0, 3), int)
    scaled = demand / limit
    weight = (scaled * left[:, None]).sum(0) if len(kinds) else np.ones(3)
    sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
    number, remaining = -1, int(left.sum())
    while remaining:
        number, room, at = number + 1, np.array([tokens, segments, loss_tokens]), 0
        while True:
            # kinds are in order of length: those too long for the room need no look
            top = np.searchsorted(kinds[:, 0], room[0], side="right")
            fits = (left[:top] > 0) & (demand[:top, 1] <= room[1]) & (demand[:top, 2] <= room[2])
            value = np.where(fits, scaled[:top] @ (weight * room / limit), -1.0)
            k = int(value.argmax()) if top else -1
            if k < 0 or value[k] < 0:
                break
            left[k] -= 1
            i = members[k][left[k]]
            sequence[i], offset[i] = number, at
            at += int(kinds[k, 0])
            room = room - demand[k]
            remaining -= 1
    return sequence, offset


def pack(pieces: DataFrame, *, tokens: int = 4096, segments: int = 256, loss_tokens: int | None = None, length_col: str = "length", loss_col: str = "loss", row_col: str = "piece_row", block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """pieces with sequence_id and offset: no sequence exceeds any of the three limits, pieces of a
    sequence follow one another from offset 0. row_col numbers the pieces (stable and unique); it deals
    them evenly over blocks, whatever their documents, and a block is packed in one task.

    All columns are kept; an empty table stays empty."""
    loss_tokens = tokens if loss_tokens is None else loss_tokens
    blocks = max(1, -(-pieces.count() // block_pieces))
    block = free(pieces.columns, "block")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(row_col, kind="stable")
        sequence, offset = place(pdf[length_col].to_numpy(np.int64), pdf[loss_col].to_numpy(np.int64), tokens, segments, loss_tokens)
        return pdf.assign(sequence_id=sequence + (pdf[block].to_numpy(np.int64) << 32), offset=offset).drop(columns=block)

    out = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return pieces.withColumn(block, F.pmod(F.xxhash64(row_col), F.lit(blocks))).groupBy(block).applyInPandas(run, out)


def _cut(path: str, end_id: int, tokens: int, special_as_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, row = encoder(path, special_as_text), TaskContext.get().partitionId() << 40
        for b in slices(batches, 4000):
            at, offsets, table = enc.coded(b.column(1), end_id)
            for k in range(0, b.num_rows, 1000):
                ids, ends = table.gathered(at, offsets[k : k + 1001])
                data, out, first = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B"), [], 0
                for doc, last in zip(b.column(0).slice(k, 1000).to_pylist(), ends.tolist(), strict=True):
                    for p in range(first, last, tokens):
                        n = min(tokens, last - p)
                        out.append((doc, row, p - first, n, zlib.crc32(data[4 * p : 4 * (p + n)]), last - first, n))
                        row += 1
                    first = last
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 7)], names=["doc_id", "piece_row", "start", "length", "ids_crc32", "doc_tokens", "loss"])

    return run


def cut(docs: DataFrame, vocabulary_path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, tokens: int = 4096, special_as_text: bool = False) -> DataFrame:
    """The pieces of every whole text (null: empty) with its end id: full sequences, then the rest.

    Rows: doc_id, piece_row (unique), start, length, ids_crc32, doc_tokens, loss (all of them bear loss)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_cut(vocabulary_path, end_id, tokens, special_as_text), PIECES)


def cut_turns(conversations: DataFrame, vocabulary_path: str, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learned: tuple[str, ...] = ("assistant",), end_id: int = 2, tokens: int = 4096, special_as_text: bool = False) -> DataFrame:
    """The pieces of every turn of the conversations, each turn a whole text with its end id: conv_id, turn, piece_row (unique),
    start, length, ids_crc32, turn_tokens and loss. Only turns of the learned roles bear loss, on all their ids; others,
    those of a null role as well, bear none. A null text is empty; repeated turns are all kept; an empty table gives no rows."""
    place = F.monotonically_increasing_id()
    rows = written(conversations.select(place.alias("place"), F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).isin(*learned), F.lit(False)).alias("learned"), F.col(text_col).cast("string").alias("text")), "turns")
    pieces = cut(rows, vocabulary_path, id_col="place", end_id=end_id, tokens=tokens, special_as_text=special_as_text).withColumnsRenamed({"doc_id": "place", "doc_tokens": "turn_tokens"})
    out = pieces.join(rows.drop("text"), "place")
    return out.select("conv_id", "turn", "piece_row", "start", "length", "ids_crc32", "turn_tokens", F.when(F.col("learned"), F.col("loss")).otherwise(0).cast("long").alias("loss"))


def pack_turns(conversations: DataFrame, vocabulary_path: str, *, tokens: int = 4096, segments: int = 64, loss_tokens: int = 2048, **options) -> DataFrame:
    """Instruction data packed under three limits that differ: sequences of at most so many tokens, turns and loss-bearing
    tokens. A turn is cut into pieces no longer than its loss limit allows. One row a piece, with sequence_id and offset."""
    pieces = written(cut_turns(conversations, vocabulary_path, tokens=min(tokens, loss_tokens), **options), "pieces")
    return pack(pieces, tokens=tokens, segments=segments, loss_tokens=loss_tokens).drop("piece_row")


def pack_documents(docs: DataFrame, vocabulary_path: str, *, end_id: int = 2, tokens: int = 4096, segments: int = 256) -> DataFrame:
    """Every document cut and packed; one row per piece. Texts are encoded once and not shuffled. All ids of a document bear loss,
    so of the three limits those on tokens and loss are one here; pack_turns is for data in which they differ.

    A null or empty text is its end id alone; rows of equal id or text are packed each for itself; a null id stays null;
    other columns are not read; an empty table gives no rows."""
    pieces = written(cut(docs, vocabulary_path, end_id=end_id, tokens=tokens), "pieces")
    return pack(pieces, tokens=tokens, segments=segments).drop("piece_row", "loss")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary("word_bpe_49k.json"))
