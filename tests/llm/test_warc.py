"""Archives: exact round trips."""

import gzip
import hashlib
import random
import uuid

import pyarrow as pa
import pytest

from setweave.llm import warc as W


def pages(spark):
    rng = random.Random(3)
    odd = ["", "x", "\r\n\r\n", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc", "é" * 60, "a" * 99, "a" * 100, "b" * 5000, "日本" * 4000]
    rows = [(i, f"http://x/{i} é\n", t, 0, "d") for i, t in enumerate(odd)]
    rows += [(20 + i, None, rng.choice(odd), 1, "e") for i in range(30)] + [(100, "u", None, 2, None), (None, "u", "a" * 100, 3, "f"), (3, "again", odd[8], 4, "g"), (7, "u", odd[7], 5, "h"), (7, "u", odd[7], 5, "h")]
    return spark.createDataFrame(rows, "page_id long, url string, html string, row long, digest string")


def brute(rows):
    out = []
    first = {}
    for r in rows:
        b = (r["html"] or "").encode()
        if len(b) >= 100 and r["page_id"] is not None:
            first[b] = min(first.get(b, r["page_id"]), r["page_id"])
    for r in rows:
        b = (r["html"] or "").encode()
        again = r["page_id"] is not None and first.get(b, r["page_id"]) != r["page_id"]
        out.append((r["page_id"], len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[b] if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("chunk,files", [(1 << 16, 4096), (64, 3)])
def test_round_trip(spark, tmp_path, chunk, files):
    df = pages(spark)
    path = f"file://{tmp_path}/w"
    W.write_archives(df, path, chunk_bytes=chunk, file_chunks=files)
    chunks = W.read_chunks(spark, path)
    got = sorted(map(tuple, W.records(chunks).collect()), key=str)
    assert got == brute(df.collect())
    assert chunks.where(f"length(chunk) > {chunk}").count() == 0
    if chunk == 64:
        assert chunks.where("segmented").count() > 300
    ids, members = [], 0
    for f in (tmp_path / "w").glob("part-*"):  # any reader of the format can follow the files
        data = gzip.decompress(f.read_bytes())
        assert not data or (data.startswith(b"WARC/1.1\r\n") and data.endswith(b"\r\n\r\n"))
        ids += [fields["warc-record-id"] for fields, _ in W.parse(f.read_bytes())]
        members += len([m for m in f.read_bytes().split(W.EMPTY) if m])
    assert len(ids) == len(set(ids)) == members >= len(got)  # a member a record
    assert W.records(W.read_chunks(spark.newSession(), path)).count() == len(got)


def test_one_file_goes_to_many_tasks(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, "u", rng.randbytes(200_000).hex()) for i in range(12)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    W.write_archives(df, f"file://{tmp_path}/w")
    other = spark.newSession()
    other.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    chunks = W.read_chunks(other, f"file://{tmp_path}/w")
    assert len(list((tmp_path / "w").glob("part-*"))) == 1 and chunks.rdd.getNumPartitions() > 5
    assert sorted(map(tuple, W.records(chunks).collect())) == [(i, 400_000, hashlib.sha256(t.encode()).hexdigest(), "response", None) for i, _, t in rows]


def test_members():
    odd = W.EMPTY * 3 + bytes(range(256)) * 3
    for record in (b"", odd, b"x" * 1000 + W.EMPTY, random.Random(1).randbytes(5000) + W.EMPTY + random.Random(2).randbytes(5000)):
        m = W.member(record)
        assert W.EMPTY not in m and gzip.decompress(m + W.EMPTY) == record + W.END
    assert gzip.decompress(W.EMPTY) == b""


def test_a_changed_payload_is_found():
    (record,) = W.record_chunks(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None, 100, uuid.uuid4())
    read = lambda r: list(W._read(iter([pa.RecordBatch.from_arrays([pa.array([W.member(r)])], names=["value"])])))
    assert read(record)[0].num_rows == 1
    with pytest.raises(ValueError, match="digest"):
        read(record.replace(b"payload", b"Payload"))


def test_query_on_long_and_repeated_pages(spark, tmp_path):
    rng = random.Random(8)
    long = [rng.randbytes(n).hex() for n in (40_000, 100_000, 300_000)]
    rows = [(i, "u", rng.choice([*long, "short", None, "x" * 100, long[0] + "é"])) for i in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    df.write.parquet(f"file://{tmp_path}/pages.parquet")
    got = sorted(map(tuple, W.op3_warc(spark, f"file://{tmp_path}").collect()), key=str)
    assert got == brute(df.collect()) and sum(r[3] == "revisit" for r in got) > 20


def test_empty(spark, tmp_path):
    W.write_archives(pages(spark).limit(0), f"file://{tmp_path}/w")
    assert W.records(W.read_chunks(spark, f"file://{tmp_path}/w")).count() == 0


def test_broken_archives():
    (record,) = W.record_chunks(1, "u", b"payload", "d", None, 100, uuid.uuid4())
    whole = record + W.END
    assert [b for _, b in W.parse(whole)][0].endswith(b"payload")
    assert [b for _, b in W.parse(gzip.compress(whole[:50]) + gzip.compress(whole[50:] + whole))][1].endswith(b"payload")
    for cut in (5, 60, len(whole) - 6):
        with pytest.raises(ValueError):
            list(W.parse(whole[:cut]))
    with pytest.raises(ValueError):
        list(W.parse(b"HTTP/1.1 200\r\n\r\n"))
