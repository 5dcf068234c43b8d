"""Media columns: what a binary column holds is told by its signatures, not by its declared type.

An Aho-Corasick automaton locates the magic bytes of all formats in one pass over a value. A hit counts only if the
format's validator can follow its structure and gives its length. The item at the start sets the type, correcting the
declared one; items further in are carved out as embedded media.
"""

from __future__ import annotations

import hashlib
import math
import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setweave.llm.frames import written

#: Signatures, where in the item each stands, and the format (fixed values of the formats' specifications).
MAGIC = [
    (b"\x89PNG\r\n\x1a\n", 0, "png"), (b"GIF87a", 0, "gif"), (b"GIF89a", 0, "gif"), (b"\xff\xd8\xff", 0, "jpeg"), (b"RIFF", 0, "riff"), (b"BM", 0, "bmp"),
    (b"%PDF-", 0, "pdf"), (b"PK\x03\x04", 0, "zip"), (b"\x1f\x8b\x08", 0, "gzip"), (b"OggS", 0, "ogg"), (b"fLaC", 0, "flac"), (b"MThd", 0, "midi"), (b"ftyp", 4, "mp4"),
]
TYPES = {"png": "image/png", "gif": "image/gif", "jpeg": "image/jpeg", "WAVE": "audio/wav", "WEBP": "image/webp", "AVI ": "video/avi", "bmp": "image/bmp", "pdf": "application/pdf", "zip": "application/zip", "gzip": "application/gzip", "ogg": "audio/ogg", "flac": "audio/flac", "midi": "audio/midi", "mp4": "video/mp4"}


#: The polynomial of CRC-32, lowest power first (a fixed value).
_CRC = 0xEDB88320
#: Step between the places at which a value's running CRC is kept.
_STEP = 8192


def _product(a: int, b: int) -> int:
    """The product of two polynomials of CRC-32's field."""
    out = 0
    for k in range(31, -1, -1):
        if a >> k & 1:
            out ^= b
        b = b >> 1 ^ (_CRC if b & 1 else 0)
    return out


@lru_cache(64)
def _power(k: int) -> int:
    """x to the power of 2^k there."""
    return 1 << 30 if k == 0 else _product(_power(k - 1), _power(k - 1))


@lru_cache(256)
def _shift(n: int) -> int:
    """What n bytes more multiply a CRC by."""
    out, k = 1 << 31, 3
    while n:
        if n & 1:
            out = _product(_power(k), out)
        n, k = n >> 1, k + 1
    return out


class _Marks:
    """What is found out once for a value, however many items begin in it: where end marks stand, its running CRC, and
    from which places no item of a format can end well."""

    def __init__(self, data: bytes):
        self.data, self.found, self.running, self.dead = data, {}, [], set()

    def after(self, mark: bytes, p: int) -> int:
        """The first place of the mark from p on, or -1."""
        if mark not in self.found:
            self.found[mark] = [m.start() for m in re.finditer(re.escape(mark), self.data)]
        at = self.found[mark]
        k = bisect_left(at, p)
        return at[k] if k < len(at) else -1

    def _before(self, p: int) -> int:
        if not self.running:
            self.running = [0]
            for k in range(0, len(self.data), _STEP):
                self.running.append(zlib.crc32(memoryview(self.data)[k : k + _STEP], self.running[-1]))
        k = p // _STEP
        return zlib.crc32(memoryview(self.data)[k * _STEP : p], self.running[k])

    def crc(self, p: int, q: int) -> int:
        """The CRC-32 of the bytes from p to q; a long range's from those of what ends at p and at q."""
        if q - p <= 2 * _STEP:
            return zlib.crc32(memoryview(self.data)[p:q])
        return self._before(q) ^ _product(_shift(q - p), self._before(p))


# A validator follows the item that a signature at p begins. It gives the item's form and where it ends; or None and up to where no
# other item of the format can begin. Places from which a walk has failed are kept, so that walks that meet fail at once.


def _png(d: bytes, p: int, marks: _Marks) -> tuple[str | None, int]:
    q, walked = p + 8, []
    while q + 12 <= len(d) and ("png", q) not in marks.dead:
        n, kind = struct.unpack_from(">I4s", d, q)
        if q + 12 + n > len(d) or (not walked and (kind != b"IHDR" or n != 13)) or marks.crc(q + 4, q + 8 + n) != struct.unpack_from(">I", d, q + 8 + n)[0]:
            break
        walked.append(("png", q))
        q += 12 + n
        if kind == b"IEND":
            return "png", q
    marks.dead.update([*walked, ("png", q)][1:])
    return None, p


def _gif(d: bytes, p: int, marks: _Marks) -> tuple[str | None, int]:
    if p + 13 > len(d):
        return None, p
    q, inner, walked = p + 13 + (3 << ((d[p + 10] & 7) + 1) if d[p + 10] & 0x80 else 0), False, []
    while q < len(d) and ("gif", q, inner) not in marks.dead:
        walked.append(("gif", q, inner))
        if inner:  # a chain of sub-blocks up to an empty one
            inner = d[q] > 0
            q += d[q] + 1
        elif d[q] == 0x3B:
            return "gif", q + 1
        elif d[q] == 0x21:
            q, inner = q + 2, True
        elif d[q] == 0x2C and q + 10 < len(d):
            q, inner = q + 11 + (3 << ((d[q + 9] & 7) + 1) if d[q + 9] & 0x80 else 0), True
        else:
            break
    marks.dead.update(walked)
    return None, p


def _jpeg(d: bytes, p: int, marks: _Marks) -> tuple[str | None, int]:
    q = p + 2
    while q + 4 <= len(d) and d[q] == 0xFF:
        kind = d[q + 1]
        if kind == 0xD9:
            return "jpeg", q + 2
        if kind == 0xFF:
            q += 1
            continue
        if kind == 0xD8:  # another begins
            break
        n = struct.unpack_from(">H", d, q + 2)[0]
        if n < 2 or q + 2 + n > len(d):
            return None, q
        q += 2 + n
        if kind == 0xDA:  # image data to the next marker that is not a restart
            while True:
                q = d.find(b"\xff", q)
                if q < 0 or q + 1 >= len(d):
                    return None, len(d)
                if d[q + 1] == 0 or 0xD0 <= d[q + 1] <= 0xD7:
                    q += 2
                    continue
                break
            if d[q + 1] == 0xD9:
                return "jpeg", q + 2
    return None, q


def _riff(d: bytes, p: int, marks: _Marks) -> tuple[str | None, int]:
    if p + 12 > len(d):
        return None, p
    n, form = struct.unpack_from("<I4s", d, p + 4)
    end, form = p + 8 + n, form.decode("latin-1")
    if form not in TYPES or end > len(d) or n < 4:
        return None, p
    q = last = p + 12
    while q + 8 <= end:
        last = q
        q += 8 + (struct.unpack_from("<I", d, q + 4)[0] + 1 & ~1)
    return (form, end) if q == end else (None, last)


def _bmp(d: bytes, p: int, marks: _Marks) -> tuple[str | None, int]:
    if p + 26 > len(d):
        return None, p
    n, zero, at, header = struct.unpack_from("<IIII", d, p + 2)
    return ("bmp", p + n) if zero == 0 and header in (12, 40, 52, 56, 108, 124) and 14 + header <= at <= n <= len(d) - p else (None, p)


def _pdf(d: bytes, p: int, marks: _Marks) -> tuple[str | None, int]:
    end = marks.after(b"%%EOF", p)
    return ("pdf", end + 5) if 0 < marks.after(b"startxref", p) <= end - 9 else (None, p)


def _zip(d: bytes, p: int, marks: _Marks) -> tuple[str | None, int]:
    end = marks.after(b"PK\x05\x06", p)
    if end < 0 or end + 22 > len(d):
        return None, p
    size, at, note = struct.unpack_from("<IIH", d, end + 12)
    return ("zip", end + 22 + note) if p + at + size == end and end + 22 + note <= len(d) else (None, p)


def _gzip(d: bytes, p: int, marks: _Marks) -> tuple[str | None, int]:
    z, q, step = zlib.decompressobj(31), p, 4096
    try:
        while not z.eof and q < len(d):
            z.decompress(d[q : q + step], 1 << 20)
            while z.unconsumed_tail:
                z.decompress(z.unconsumed_tail, 1 << 20)
            q += step
    except zlib.error:
        return None, q  # the portion that broke off may hold the next
    q = min(q, len(d))
    return ("gzip", q - len(z.unused_data)) if z.eof else (None, q)


def _ogg(d: bytes, p: int, marks: _Marks) -> tuple[str | None, int]:
    q, walked = p, []
    while q + 27 <= len(d) and d[q : q + 4] == b"OggS" and d[q + 4] == 0 and ("ogg", q) not in marks.dead:
        walked.append(("ogg", q))
        end, n = d[q + 5] & 4, d[q + 26]
        q += 27 + n + sum(d[q + 27 : q + 27 + n])
        if end and q <= len(d):
            return "ogg", q
        if end:
            break
    marks.dead.update(walked)
    return None, p


def _flac(d: bytes, p: int, marks: _Marks) -> tuple[str | None, int]:
    q, first = p + 4, True
    while q + 4 <= len(d):
        head, n = d[q], int.from_bytes(d[q + 1 : q + 4], "big")
        if (first and (head & 127 or n != 34)) or q + 4 + n > len(d):
            return None, q
        q, first = q + 4 + n, False
        if head & 128:  # frames follow to the end of the value
            return ("flac", len(d)) if q + 2 <= len(d) and d[q] == 0xFF and d[q + 1] & 0xFC == 0xF8 else (None, q)
    return None, q


def _midi(d: bytes, p: int, marks: _Marks) -> tuple[str | None, int]:
    if p + 14 > len(d) or struct.unpack_from(">I", d, p + 4)[0] != 6:
        return None, p
    q = last = p + 14
    for _ in range(struct.unpack_from(">H", d, p + 10)[0]):
        if d[q : q + 4] != b"MTrk" or q + 8 > len(d):
            return None, last
        last = q
        q += 8 + struct.unpack_from(">I", d, q + 4)[0]
    return ("midi", q) if p + 14 < q <= len(d) else (None, last)


def _mp4(d: bytes, p: int, marks: _Marks) -> tuple[str | None, int]:
    q, kinds, walked = p, [], []
    while p >= 0 and q + 8 <= len(d) and ("mp4", q) not in marks.dead:
        n, kind = struct.unpack_from(">I4s", d, q)
        if n < 8 or q + n > len(d) or not kind.isalnum():
            break
        kinds.append(kind)
        walked.append(("mp4", q))
        q += n
    if kinds[:1] == [b"ftyp"] and b"moov" in kinds:
        return "mp4", q
    marks.dead.update(walked[1:] if b"moov" in kinds else walked)
    return None, p


_VALID = {"png": _png, "gif": _gif, "jpeg": _jpeg, "riff": _riff, "bmp": _bmp, "pdf": _pdf, "zip": _zip, "gzip": _gzip, "ogg": _ogg, "flac": _flac, "midi": _midi, "mp4": _mp4}


@lru_cache(1)
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for magic, at, kind in MAGIC:
        found.add_word(magic.decode("latin-1"), (len(magic) - 1 + at, kind))
    found.make_automaton()
    return found


def sniff(data: bytes, deep: bool = True) -> tuple[str | None, int, list[tuple[int, int, str]]]:
    """The type of the item at the start (None: not known), its length, and the items carved from what follows its
    signature: (offset, length, type), those inside a carved item left out.

    The work grows with the value's length, whatever it holds: end marks are looked for once, checksums of long ranges come
    from running ones, and no place is walked from twice. A broken gzip, JPEG, RIFF, FLAC or MIDI item keeps the whole parts
    that could be followed: a signature of its own format in there begins no other item."""
    kind, size, carved, free, marks, read = None, 0, [], 1, _Marks(data), dict.fromkeys(_VALID, 0)
    for end, (back, name) in _automaton().iter(data.decode("latin-1")):
        at = end - back
        if at < read[name] or (at != 0 and (at < free or not deep)):
            continue
        form, stop = _VALID[name](data, at, marks)
        if form is None:
            read[name] = max(read[name], stop)
        elif at == 0:
            kind, size = TYPES[form], stop
        else:
            carved.append((at, stop - at, TYPES[form]))
            free = stop
    return kind, size, carved


def wav(payload: bytes, n_bytes: int, rate: int = 8000) -> bytes:
    """The payload as 8-bit mono samples; a chunk of its own holds the length without padding."""
    chunks = [(b"fmt ", struct.pack("<HHIIHH", 1, 1, rate, rate, 1, 8)), (b"nbyt", struct.pack("<Q", n_bytes)), (b"data", payload)]
    body = b"WAVE" + b"".join(k + struct.pack("<I", len(c)) + c + b"\0" * (len(c) & 1) for k, c in chunks)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def unwav(data: bytes) -> tuple[bytes, int]:
    """(samples, length without padding) of wav()."""
    q, out = 12, {}
    while q + 8 <= len(data):
        kind, n = struct.unpack_from("<4sI", data, q)
        out[kind] = data[q + 8 : q + 8 + n]
        q += 8 + (n + 1 & ~1)
    return out[b"data"], struct.unpack("<Q", out[b"nbyt"])[0]


def _batches(rows: Iterator[tuple], schema: pa.Schema, weight: int, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[weight] or b"") + 100
        if size >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _store(unit: int):
    schema = pa.schema([("id", pa.int64()), ("media", pa.binary()), ("declared", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                for k, text in zip(b.column(0), b.column(1), strict=True):
                    t = text.as_py() or b""
                    yield k.as_py(), wav(t + b"\xff" * (-len(t) % unit or unit * (not t)), len(t)), "application/octet-stream"

        yield from _batches(rows(), schema, 1)

    return run


def store_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", unit: int = 576) -> DataFrame:
    """(id, media, declared): every whole text (null: empty) in UTF-8, padded with bytes 255 to a positive multiple of
    unit, as the samples of a WAV value, with a declared type that says nothing yet. Equal texts give equal values, repeated
    rows and ids are all kept; other columns are not read; an empty table gives no rows."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(_store(unit), "id long, media binary, declared string")


SNIFFED = "id long, declared string, detected string, corrected boolean, media_bytes long, item_bytes long, carved array<struct<offset:long,bytes:long,type:string,sha256:string>>"


def _sniff(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(0, b.num_rows, 500):
            part, out = b.slice(k, 500), []
            for i, media, declared in zip(*(part.column(c) for c in range(3)), strict=True):
                data = media.as_py() or b""
                kind, size, carved = sniff(data)
                said = declared.as_py()
                out.append((i.as_py(), said, kind or said, kind is not None and kind != said, len(data), size, [{"offset": o, "bytes": n, "type": t, "sha256": hashlib.sha256(data[o : o + n]).hexdigest()} for o, n, t in carved]))
            types = [pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.struct([("offset", pa.int64()), ("bytes", pa.int64()), ("type", pa.string()), ("sha256", pa.string())]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["id", "declared", "detected", "corrected", "media_bytes", "item_bytes", "carved"])


def sniff_column(rows: DataFrame, *, id_col: str = "id", media_col: str = "media", declared_col: str = "declared") -> DataFrame:
    """For each row its declared and detected type, whether that corrects it, the length of the value and of its valid item,
    and the media carved from it. Where no signature holds the declared type stays, null if it is; a null value is empty.
    Repeated rows and ids are all kept; other columns are not read; an empty table gives no rows."""
    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).alias("media"), F.col(declared_col).cast("string").alias("declared")).mapInArrow(_sniff, SNIFFED)


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, detected string, corrected boolean"


def features(payload: bytes) -> str:
    """Mean, spread and entropy of the samples, and how often they cross their middle."""
    x = np.frombuffer(payload, np.uint8)
    n = np.bincount(x, minlength=256).astype(float)
    p, v = n / max(1, len(x)), np.arange(256)
    mean = float((p * v).sum())
    spread = math.sqrt(max(0.0, float((p * v * v).sum()) - mean * mean))
    entropy = float(-(p[p > 0] * np.log2(p[p > 0])).sum())
    high = x > 127
    return f"mean={mean:.6f};spread={spread:.6f};entropy={entropy:.6f};crossings={int(np.count_nonzero(high[1:] != high[:-1]))}"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_()]
    names = [x.split()[0] for x in DIGEST.split(", ")]
    for b in batches:
        for k in range(0, b.num_rows, 500):
            part, out = b.slice(k, 500), []
            for i, media, declared in zip(*(part.column(c) for c in range(3)), strict=True):
                data = media.as_py()
                kind, size, carved = sniff(data)
                if kind != "audio/wav" or size != len(data):
                    raise ValueError("a stored value does not read back as it was written")
                payload, n = unwav(data)
                feature = f"type={kind};{features(payload)};carved=" + "|".join(f"{t}@{o}+{m}" for o, m, t in carved)
                out.append((i.as_py(), n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature, kind, kind != declared.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)


def digest_column(stored: DataFrame) -> DataFrame:
    """Reads back the values of store_texts: sniffs each, checks its structure, and digests its payload, tail and stored form.
    One row for each of stored, null ids included; a value that is no whole WAV is an error; an empty table gives no rows."""
    return stored.select("id", "media", "declared").mapInArrow(_digest, DIGEST)


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents stored as media, a table in the shared folder, and read back from there."""
    stored = written(store_texts(spark.read.parquet(f"{sf_dir}/documents.parquet")), "media")
    return digest_column(stored)
