"""Sequences within their limits, and pieces that hold every id once."""

import zlib

import numpy as np
import pytest
from messy import documents
from pyspark.sql import functions as F

from setweave.llm import packing as P
from setweave.llm.tokens import encoder, vocabulary

PATH = vocabulary("word_bpe_49k.json")


@pytest.mark.parametrize("tokens,segments,loss", [(100, 5, 60), (100, 1000, 100), (64, 2, 64)])
def test_limits(tokens, segments, loss):
    rng = np.random.default_rng(tokens)
    length = rng.integers(1, tokens + 1, 500)
    bears = np.minimum((length * rng.random(500)).astype(int), loss)
    sequence, offset = P.place(length, bears, tokens, segments, loss)
    for s in np.unique(sequence):
        at = np.flatnonzero(sequence == s)
        at = at[np.argsort(offset[at])]
        assert length[at].sum() <= tokens and len(at) <= segments and bears[at].sum() <= loss
        assert offset[at].tolist() == (np.cumsum(length[at]) - length[at]).tolist()
    floor = max(length.sum() / tokens, 500 / segments, bears.sum() / loss)
    assert sequence.max() + 1 <= 1.4 * floor + 1


def test_a_piece_beyond_a_limit_is_refused():
    with pytest.raises(ValueError):
        P.place(np.array([101]), np.array([1]), 100, 5, 100)
    assert [len(x) for x in P.place(np.zeros(0, int), np.zeros(0, int), 100, 5, 100)] == [0, 0]


def check(rows, docs, tokens):
    enc = encoder(PATH)
    ids = sorted([(r["doc_id"], [*enc.tok.encode(r["text"] or "", add_special_tokens=False).ids, 2]) for r in docs.select("doc_id", "text").collect()], key=str)
    pieces = {}
    for r in rows:
        pieces.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    want = {}
    for d, x in ids:
        want.setdefault((d, len(x)), []).append(x)
    assert pieces.keys() == want.keys()
    for key, xs in want.items():
        cuts = sorted((start, min(tokens, key[1] - start), zlib.crc32(np.array(x[start : start + tokens], "<u4").tobytes())) for x in xs for start in range(0, key[1], tokens))
        assert sorted((r["start"], r["length"], r["ids_crc32"]) for r in pieces[key]) == cuts
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        end = 0
        for o, n in sorted(parts):
            assert o == end
            end += n
        assert end <= tokens
    return sequences


def test_messy_documents(spark):
    docs = documents(spark)
    check(P.pack_documents(docs, PATH, tokens=64).collect(), docs, 64)
    check(P.pack_documents(docs, PATH).collect(), docs, 4096)
    assert P.pack_documents(docs.limit(0), PATH).count() == 0


def test_little_padding_and_blocks(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = P.op7_packing(spark, "/root/testdata/sf0.01").collect()
    sequences = check(rows, docs, 4096)
    total = sum(r["length"] for r in rows)
    assert 4096 * len(sequences) < 1.02 * total
    pieces = spark.range(5000).select(F.col("id").alias("piece_row"), F.lit(1).alias("doc_id"), (F.col("id") % 50 + 1).alias("length"), F.lit(0).alias("loss"))
    packed = P.pack(pieces, tokens=100, segments=10, block_pieces=300)
    assert packed.columns == [*pieces.columns, "sequence_id", "offset"] and packed.count() == 5000
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.count("*").alias("k")).where("n > 100 or k > 10").count() == 0


def test_turns_under_three_limits(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    odd = spark.createDataFrame([(1 << 40, 0, "assistant", "long answer " * 9000), (1 << 40, 1, None, None), (None, 2, "user", ""), (7, None, "assistant", "<|endoftext|> x"), (7, None, "assistant", "<|endoftext|> x")], "conv_id long, turn long, role string, text string")
    rows = docs.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(odd)
    got = P.pack_turns(rows, PATH, tokens=1024, segments=12, loss_tokens=300).collect()
    sequences, enc = {}, encoder(PATH).tok
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append(r)
    tight = [0, 0, 0]
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r["offset"])
        used = (sum(r["length"] for r in pieces), len(pieces), sum(r["loss"] for r in pieces))
        assert used[0] <= 1024 and used[1] <= 12 and used[2] <= 300
        assert [r["offset"] for r in pieces] == (np.cumsum([r["length"] for r in pieces]) - [r["length"] for r in pieces]).tolist()
        tight = [t + (u >= 0.95 * most) for t, u, most in zip(tight, used, (1024, 12, 300), strict=True)]
    assert tight[1] and tight[2]  # the other two limits bind as well
    want = {}
    for r in rows.collect():
        ids = [*enc.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        n, loss = want.get((r["conv_id"], r["turn"]), (0, 0))
        want[r["conv_id"], r["turn"]] = n + len(ids), loss + len(ids) * (r["role"] == "assistant")
    sums = {}
    for r in got:
        n, loss = sums.get((r["conv_id"], r["turn"]), (0, 0))
        sums[r["conv_id"], r["turn"]] = n + r["length"], loss + r["loss"]
    assert sums == want
    assert P.pack_turns(rows.limit(0), PATH).count() == 0
