"""Signatures, validators, carving, and stored texts."""

import gzip
import hashlib
import io
import struct
import time
import zipfile
import zlib

import pytest
from messy import documents

from setweave.llm import media as M


def png():
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\x7f")) + chunk(b"IEND", b"")


def archive():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "hello")
    return out.getvalue()


GIF = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + b"\0\0\0\xff\xff\xff" + b"!\xf9\x04\0\0\0\0\0" + b",\0\0\0\0\1\0\1\0\0" + b"\x02\x02D\x01\0" + b";"
JPEG = b"\xff\xd8\xff\xe0\0\x04ab" + b"\xff\xda\0\x04ab" + b"data\xff\0more\xff\xd0x" + b"\xff\xd9"
BMP = b"BM" + struct.pack("<IIIIiiHHIIIIII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"abcd"
PDF = b"%PDF-1.4\n1 0 obj\nendobj\nstartxref\n9\n%%EOF"
MIDI = b"MThd" + struct.pack(">IHHH", 6, 0, 1, 96) + b"MTrk" + struct.pack(">I", 4) + b"\0\xff\x2f\0"
OGG = b"OggS\0\x04" + bytes(20) + b"\x01\x03abc"
MP4 = struct.pack(">I4s", 16, b"ftyp") + b"isom\0\0\0\0" + struct.pack(">I4s", 12, b"moov") + b"abcd"
FLAC = b"fLaC" + b"\x80\0\0\x22" + bytes(34) + b"\xff\xf8rest"
ITEMS = {"image/png": png(), "image/gif": GIF, "image/jpeg": JPEG, "image/bmp": BMP, "application/pdf": PDF, "audio/midi": MIDI, "audio/ogg": OGG, "video/mp4": MP4, "application/zip": archive(), "application/gzip": gzip.compress(b"hello" * 100), "audio/wav": M.wav(b"abc", 3), "audio/flac": FLAC}


@pytest.mark.parametrize("kind", sorted(ITEMS))
def test_each_format(kind):
    data = ITEMS[kind]
    assert M.sniff(data)[:2] == (kind, len(data))
    for cut in range(1, len(data)):
        assert M.sniff(data[:cut])[0] in (None, *(["audio/flac"] if kind == "audio/flac" else []), *(["video/mp4"] if kind == "video/mp4" else []))
    if kind not in ("audio/flac",):
        found = M.sniff(b"prefix" + data + b"suffix")
        assert found[0] is None and (6, len(data), kind) in found[2]


def test_signatures_without_structure():
    for text in (b"BM is two letters", b"GIF89a and so on", b"RIFF raff", b"%PDF- no", b"PK\x03\x04", b"ftyp", b""):
        assert M.sniff(text) == (None, 0, [])


@pytest.mark.parametrize("unit", [b"%PDF-", b"PK\x03\x04", b"OggS\0\0" + bytes(20) + b"\0", b"\x1f\x8b\x08\0\0\0\0\0\0\3", b"\xff\xd8\xff\xda\0\2", b"GIF89a" + bytes(7), b"\x89PNG\r\n\x1a\n" + png()[8:33] + struct.pack(">I", 30_000) + b"IDAT"])
def test_work_grows_with_the_length(unit):
    def took(n):
        data, best = unit * (n // len(unit)), 9e9
        for _ in range(3):
            began = time.process_time()
            M.sniff(data)
            best = min(best, time.process_time() - began)
        return best

    assert took(800_000) < 2 and took(800_000) < 30 * took(100_000) + 0.1  # quadratic: 64 times


def test_crc_of_ranges():
    data = bytes(range(256)) * 400
    marks = M._Marks(data)
    for p, q in ((0, 0), (3, 90), (0, 102_400), (17, 70_001), (8192, 65_536), (9000, 102_399)):
        assert marks.crc(p, q) == zlib.crc32(data[p:q])


def test_items_after_broken_ones():
    for kind in ("image/png", "image/gif", "image/jpeg", "audio/ogg", "application/gzip", "audio/midi", "video/mp4", "audio/wav"):
        item = ITEMS[kind]
        for broken in (item[:9], item[: len(item) - 6] if kind != "application/gzip" else item[:8]):
            found = M.sniff(b"x" + broken + b"." * 300 + item)
            assert (301 + len(broken), len(item), kind) in found[2], (kind, broken)


def test_column(spark):
    rows = [(1, ITEMS["image/png"], "image/jpeg"), (2, b"text" + GIF + b"more" + PDF, "text/plain"), (3, None, None), (4, b"", "x"), (5, GIF, "image/gif"), (5, GIF, "image/gif")]
    got = sorted(M.sniff_column(spark.createDataFrame(rows, "id long, media binary, declared string")).collect(), key=lambda r: r["id"])
    assert [(r["detected"], r["corrected"]) for r in got] == [("image/png", True), ("text/plain", False), (None, False), ("x", False), ("image/gif", False), ("image/gif", False)]
    assert [(c["offset"], c["bytes"], c["type"], c["sha256"]) for c in got[1]["carved"]] == [(4, len(GIF), "image/gif", hashlib.sha256(GIF).hexdigest()), (8 + len(GIF), len(PDF), "application/pdf", hashlib.sha256(PDF).hexdigest())]


def test_stored_texts(spark):
    docs = documents(spark)
    got = sorted(M.digest_column(M.store_texts(docs)).collect(), key=lambda r: (str(r["doc_id"]), r["payload_sha256"]))
    want = []
    for r in docs.select("doc_id", "text").collect():
        b = (r["text"] or "").encode()
        p = b + b"\xff" * (-len(b) % 576 or (0 if b else 576))
        media = M.wav(p, len(b))
        want.append((r["doc_id"], len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(media), hashlib.sha256(media).hexdigest()))
    assert [tuple(r)[:7] for r in got] == sorted(want, key=lambda r: (str(r[0]), r[3]))
    assert len({(r["payload_sha256"], r["feature"], r["media_sha256"]) for r in got}) == len({r["payload_sha256"] for r in got})
    assert M.digest_column(M.store_texts(docs.limit(0))).count() == 0
    full = M.wav(b"a" * 576 * 3, 576 * 3)
    assert M.unwav(full) == (b"a" * 576 * 3, 576 * 3)
