"""WARC archives as tables of record chunks.

A payload longer than a chunk is written as WARC segments: the record itself and its continuation records,
numbered from 1. So each row that is written or read back holds one chunk at most, and a record's digest is
carried from chunk to chunk; no task ever holds an oversized record as a whole beside its source row.

Every record is a gzip member of its own, as WARC wants it. The rows are written by Spark's own text writer, to any file
system that it can write; what it puts after each is an empty gzip member, which readers of the format pass over. It does not occur
within a member, so Spark's text reader cuts archives of any size at these places and hands them to many tasks, record by record.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setweave.llm.frames import scratch, written

END = b"\r\n\r\n"
#: What stands between records: a gzip member that holds nothing.
EMPTY = b"\x1f\x8b\x08\0\0\0\0\0\0\xff\3\0\0\0\0\0\0\0\0\0"
CHUNKS = "record_id string, page_id long, record_type string, refers_to long, declared string, chunk_no int, segmented boolean, payload_bytes long, payload_digest string, chunk binary"
OUT = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def _uri(url: str | None) -> str:
    return "".join(c if " " < c != "\x7f" else f"%{ord(c):02X}" for c in url or "")


def record_chunks(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, chunk_bytes: int, number: uuid.UUID) -> Iterator[bytes]:
    """The WARC record of a page, and its continuation records, each without the line ends after it. A revisit
    has the HTTP header as its block and refers to the response; a response's payload is cut into chunks. number makes the
    record's id, from which those of its continuations follow."""
    name = f"<{number.urn}>"
    head = [("WARC-Record-ID", name), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", _uri(url)), ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", str(len(payload)))]
    head += [("X-Page-ID", str(page_id))] * (page_id is not None)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)

    def record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
        fields = [("WARC-Type", kind), *fields, ("Content-Length", str(len(block)))]
        return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode() + block

    if refers_to is not None:
        revisit = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page-ID", str(refers_to))]
        yield record("revisit", head + revisit, http)
        return
    kind = [("Content-Type", "application/http; msgtype=response")]
    if len(payload) <= chunk_bytes:
        yield record("response", head + kind, http + payload)
        return
    view, total = memoryview(payload), len(http) + len(payload)
    yield record("response", [*head, *kind, ("WARC-Segment-Number", "1")], http + view[:chunk_bytes])
    for k, at in enumerate(range(chunk_bytes, len(payload), chunk_bytes), 2):
        end = [("WARC-Segment-Total-Length", str(total))] * (at + chunk_bytes >= len(payload))
        yield record("continuation", [("WARC-Record-ID", f"<{uuid.uuid5(number, str(k)).urn}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", _uri(url)), ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", str(k)), *end], bytes(view[at : at + chunk_bytes]))


def member(record: bytes, level: int = 6) -> bytes:
    """A record and the line ends after it as a gzip member in which EMPTY does not stand."""
    data, z = record + END, zlib.compressobj(level, zlib.DEFLATED, 31)
    out = z.compress(data) + z.flush()
    if EMPTY in out:  # in a block that is stored as it is: blocks now end in the middle of it
        z, half = zlib.compressobj(level, zlib.DEFLATED, 31), len(EMPTY) // 2
        first, *rest = data.split(EMPTY)
        parts = [z.compress(first)]
        for part in rest:
            parts += [z.compress(EMPTY[:half]), z.flush(zlib.Z_FULL_FLUSH), z.compress(EMPTY[half:] + part)]
        out = b"".join(parts) + z.flush()
    if EMPTY in out:
        raise ValueError("a record cannot be told apart from what stands between records")
    return out


def _write(chunk_bytes: int, run_id: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size, base = [], 0, uuid.UUID(run_id)
        for b in batches:
            for page, url, html, digest, refers, row in zip(*(b.column(k) for k in range(6)), strict=True):
                for r in record_chunks(page.as_py(), url.as_py(), html.as_py() or b"", digest.as_py(), refers.as_py(), chunk_bytes, uuid.uuid5(base, str(row.as_py()))):
                    out.append(member(r))
                    size += len(out[-1])
                    if size >= 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
                        out, size = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    return run


def write_archives(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 100, chunk_bytes: int = 1 << 16, file_chunks: int = 1 << 16) -> None:
    """Writes one WARC record for each row of pages. Of rows with equal payloads of least_bytes or more, those
    with the smallest page_id are responses and the others revisit it; all other rows are responses.

    A null html is an empty payload; a row without page_id is a response that nothing refers to; a null url is empty.
    Repeated rows have a record each. Other columns are not read; an empty table gives archives without records. Record ids
    are unique over all archives: they follow from one drawn for this call and the row's number. A file holds file_chunks
    chunks at most. Payloads stay where they are read unless the revisits, written first, are too many for Spark's
    own broadcast limit."""
    html = F.coalesce(F.col(html_col).cast("string").cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    small = rows.where(F.octet_length("html") >= least_bytes).select("page_id", "digest")
    first = small.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("most")).where("refers_to < most").drop("most")
    first = written(first, "first")  # so that a join with a page that comes very often can be split
    revisits = small.join(first, "digest").where("page_id > refers_to").distinct()
    revisits = written(revisits.select("page_id", "digest", "refers_to"), "revisits")
    rows = rows.join(revisits, ["page_id", "digest"], "left").select("page_id", "url", "html", "digest", "refers_to", F.monotonically_increasing_id().alias("row"))
    records = rows.mapInArrow(_write(chunk_bytes, str(uuid.uuid4())), "value binary").select(F.col("value").cast("string"))
    records.write.option("lineSep", EMPTY.decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", file_chunks).text(path)


def _inflated(data: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of a gzip file, some at a time; data that is not gzip as it is."""
    if data[:2] != b"\x1f\x8b":
        yield from (data[k : k + step] for k in range(0, len(data), step))
        return
    at, size = 0, len(data)
    while at < size:
        member = zlib.decompressobj(31)
        while not member.eof and at < size:
            part = data[at : at + step]
            at += len(part)
            yield member.decompress(part)
        at -= len(member.unused_data)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an archive: header fields, lower-case, and block. Blocks are as long as their
    Content-Length says, whatever they contain."""
    held, at, source = b"", 0, _inflated(data)

    def more() -> bool:
        nonlocal held, at
        part = next(source, None)
        if part is None:
            return False
        held, at = held[at:] + part, 0
        return True

    while True:
        while (end := held.find(END, at)) < 0:
            if not more():
                if held[at:].strip():
                    raise ValueError("an archive ends within a record's header")
                return
        lines = held[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        n, at = int(fields["content-length"]), end + 4
        while len(held) - at < n + 4:
            if not more():
                raise ValueError("an archive ends within a record")
        yield fields, held[at : at + n]
        at += n + 4


def _row(f: dict[str, str], block: bytes) -> tuple:
    kind, number = f["warc-type"], int(f.get("warc-segment-number", 0))
    payload = block if kind == "continuation" else block[block.index(END) + 4 :]
    declared = f.get("warc-payload-digest", "").removeprefix("sha256:")
    digest = declared if kind == "revisit" else None if number else hashlib.sha256(payload).hexdigest()
    if digest is not None and digest != declared:
        raise ValueError(f"record {f['warc-record-id']} does not have the digest it declares")
    origin, page = f.get("warc-segment-origin-id", f["warc-record-id"]), int(f["x-page-id"]) if "x-page-id" in f else None
    return origin, page, kind, int(f["x-refers-to-page-id"]) if kind == "revisit" else None, declared, number, number > 0, int(f["x-payload-length"]) if kind == "revisit" else len(payload), digest, payload if number else None


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("declared", pa.string()), ("chunk_no", pa.int32()), ("segmented", pa.bool_()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("chunk", pa.binary())])
    rows = lambda out: pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
    for b in batches:
        out, size = [], 0
        for data in b.column(0):
            for fields, block in parse(data.as_py()):
                out.append(_row(fields, block))
                size += 100 + len(out[-1][-1] or b"")
                if size >= 4 << 20:
                    yield rows(out)
                    out, size = [], 0
        if out:
            yield rows(out)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunk rows of archives that write_archives wrote: record_id, page_id, record_type, refers_to, declared (digest),
    chunk_no (0: the record is not segmented), segmented, payload_bytes (of the chunk; of a revisit, of what it revisits),
    payload_digest (null for chunks of segmented records) and chunk (null for whole records, whose digest is already taken).

    A whole record whose payload does not have the digest it declares is an error. Large archives are read by many
    tasks, one record at a time; archives without records give no rows."""
    members = spark.read.option("lineSep", EMPTY.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)
    return members.select(F.col("value").cast("binary").alias("value")).mapInArrow(_read, CHUNKS)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each record from its chunks in order; the digest is carried from chunk to chunk."""
    state: list | None = None

    def row(s: list) -> pa.RecordBatch:
        if s[5].hexdigest() != s[4]:
            raise ValueError(f"record {s[0]} does not have the digest it declares")
        return pa.RecordBatch.from_arrays([pa.array([s[1]], pa.int64()), pa.array([s[3]], pa.int64()), pa.array([s[5].hexdigest()]), pa.array([s[2]]), pa.array([None], pa.int64())], names=OUT)

    for b in batches:
        for rec, page, kind, declared, number, chunk in zip(*(b.column(n) for n in ("record_id", "page_id", "record_type", "declared", "chunk_no", "chunk")), strict=True):
            if state is None or state[0] != rec.as_py():
                if state is not None:
                    yield row(state)
                state = [rec.as_py(), page.as_py(), kind.as_py(), 0, declared.as_py(), hashlib.sha256(), 0]
            if number.as_py() != state[6] + 1:
                raise ValueError(f"record {state[0]} lacks a segment")
            state[6] += 1
            part = chunk.as_buffer()
            state[3] += part.size
            state[5].update(part)
    if state is not None:
        yield row(state)


def records(chunks: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) for each record of read_chunks. Only chunks of
    segmented records are shuffled, by their record, and folded in order. A record that lacks a segment or does not have the
    digest it declares is an error; a null page_id stays null, repeated records are all kept, no chunks give no rows."""
    whole = chunks.where("not segmented").select(*OUT)
    parts = chunks.where("segmented").select("record_id", "page_id", "record_type", "declared", "chunk_no", "chunk")
    folded = parts.repartition("record_id").sortWithinPartitions("record_id", "chunk_no").mapInArrow(_fold, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    return whole.unionByName(folded)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC archives and read back."""
    path = scratch(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return records(read_chunks(spark, path))
