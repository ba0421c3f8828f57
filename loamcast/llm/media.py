"""Media columns: signature sniffing, validation and carving.

An Aho-Corasick automaton finds the magic bytes of known formats anywhere in
a blob; a validator of the format then walks its structure, checks lengths
and checksums, and gives the true extent. So a declared type can be corrected
and media inside other data can be carved out.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_map, table, text_blocks

ROW = 576  # samples of one image row
PNG = b"\x89PNG\r\n\x1a\n"
OTHER = "application/octet-stream"
#: Magic bytes and the formats that they announce.
MAGIC = {PNG: "image/png", b"RIFF": "audio/wav", b"GIF87a": "image/gif", b"GIF89a": "image/gif", b"\xff\xd8\xff": "image/jpeg", b"BM": "image/bmp"}


@functools.cache
def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for magic, kind in MAGIC.items():
        found.add_word(magic.decode("latin-1"), (len(magic), kind))
    found.make_automaton()
    return found


def png_end(blob: bytes, at: int) -> int | None:
    """Where the PNG that starts at `at` ends; None if it isn't one."""
    pos, first = at + len(PNG), True
    while pos + 12 <= len(blob):
        n, kind = struct.unpack_from(">I4s", blob, pos)
        end = pos + 12 + n
        if end > len(blob) or first and (kind, n) != (b"IHDR", 13):
            return None
        if zlib.crc32(memoryview(blob)[pos + 4 : end - 4]) != struct.unpack_from(">I", blob, end - 4)[0]:
            return None
        if kind == b"IEND":
            return end
        pos, first = end, False
    return None


def wav_end(blob: bytes, at: int) -> int | None:
    if at + 12 > len(blob) or blob[at + 8 : at + 12] != b"WAVE":
        return None
    end = at + 8 + struct.unpack_from("<I", blob, at + 4)[0]
    if end > len(blob):
        return None
    pos, kinds = at + 12, []
    while pos + 8 <= end:
        kind, n = struct.unpack_from("<4sI", blob, pos)
        kinds.append(kind)
        pos += 8 + n + n % 2
    return end if pos == end and {b"fmt ", b"data"} <= set(kinds) else None


def gif_end(blob: bytes, at: int) -> int | None:
    if at + 13 > len(blob):
        return None
    flags, pos = blob[at + 10], at + 13
    pos += 3 << (flags & 7) + 1 if flags & 0x80 else 0
    try:
        while True:
            kind = blob[pos]
            if kind == 0x3B:
                return pos + 1
            if kind == 0x2C:
                flags = blob[pos + 9]
                pos += 10 + (3 << (flags & 7) + 1 if flags & 0x80 else 0) + 1
            elif kind == 0x21:
                pos += 2
            else:
                return None
            while blob[pos]:
                pos += blob[pos] + 1
            pos += 1
    except IndexError:
        return None


def jpeg_end(blob: bytes, at: int) -> int | None:
    pos, scanned = at + 2, False
    while pos + 4 <= len(blob) and blob[pos] == 0xFF:
        kind = blob[pos + 1]
        if kind == 0xD9:
            return pos + 2 if scanned else None
        pos += 2 + struct.unpack_from(">H", blob, pos + 2)[0]
        if kind == 0xDA:
            scanned = True
            while (pos := blob.find(b"\xff", pos)) >= 0 and pos + 1 < len(blob) and (blob[pos + 1] == 0 or 0xD0 <= blob[pos + 1] <= 0xD7):
                pos += 2
            if pos < 0:
                return None
            if blob[pos : pos + 2] == b"\xff\xd9":
                return pos + 2
    return None


def bmp_end(blob: bytes, at: int) -> int | None:
    if at + 54 > len(blob):
        return None
    size, zero, offset, header, width, height, planes, bits = struct.unpack_from("<IIIIiiHH", blob, at + 2)
    stride = (abs(width) * bits + 31) // 32 * 4
    exact = zero == 0 and header >= 40 and planes == 1 and bits in (1, 4, 8, 16, 24, 32) and size == offset + stride * abs(height)
    return at + size if exact and size >= 54 and at + size <= len(blob) else None


ENDS = {"image/png": png_end, "audio/wav": wav_end, "image/gif": gif_end, "image/jpeg": jpeg_end, "image/bmp": bmp_end}


def carve(blob: bytes) -> list[tuple[int, int, str]]:
    """(start, end, type) of each valid medium in the blob, in order and
    without overlaps: what lies inside one that was found is part of it."""
    found, done = [], 0
    for last, (n, kind) in automaton().iter(blob.decode("latin-1")):
        start = last - n + 1
        if start >= done and (end := ENDS[kind](blob, start)):
            found.append((start, end, kind))
            done = end
    return found


def sniff(blob: bytes) -> str:
    """The type of a blob by its content; octet-stream where none fits whole."""
    found = carve(blob)
    return found[0][2] if found and found[0][:2] == (0, len(blob)) else OTHER


def encode_png(payload: bytes) -> bytes:
    """Grey 8-bit image of ROW samples a line; payload: a positive multiple."""
    height = len(payload) // ROW
    raw = b"".join(b"\0" + payload[i : i + ROW] for i in range(0, len(payload), ROW))

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))

    return PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", ROW, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 1)) + chunk(b"IEND", b"")


def png_data(blob: bytes) -> bytes:
    """The unpacked lines of a valid PNG; none where they can't be unpacked."""
    pos, data = len(PNG), []
    while pos < len(blob):
        n, kind = struct.unpack_from(">I4s", blob, pos)
        if kind == b"IDAT":
            data.append(blob[pos + 8 : pos + 8 + n])
        pos += 12 + n
    try:
        return zlib.decompress(b"".join(data))
    except zlib.error:
        return b""


def unfiltered(raw: bytes, width: int) -> bytes:
    """Samples of PNG lines of `width` bytes a sample row, one byte a sample."""
    out, before = [], bytes(width)
    for i in range(0, len(raw), width + 1):
        kind, line = raw[i], bytearray(raw[i + 1 : i + 1 + width])
        for x in range(width) if kind else ():
            left, up = (line[x - 1] if x else 0), before[x]
            corner = before[x - 1] if x else 0
            guess = left + up - corner
            nearest = min((abs(guess - left), 0, left), (abs(guess - up), 1, up), (abs(guess - corner), 2, corner))[2]
            line[x] = (line[x] + (0, left, up, (left + up) // 2, nearest)[kind]) & 255
        before = bytes(line)
        out.append(before)
    return b"".join(out)


def samples_of(kind: str, blob: bytes) -> tuple[int, bytes] | None:
    """(samples a line, samples) of grey 8-bit PNG; None of other media, whose
    bytes are their samples."""
    if kind != "image/png" or blob[24:29] != b"\x08\0\0\0\0":
        return None
    width, height = struct.unpack_from(">II", blob, 16)
    raw = png_data(blob)
    return (width, unfiltered(raw, width)) if len(raw) == height * (width + 1) and all(f < 5 for f in raw[:: width + 1]) else None


def feature_of(kind: str, samples: bytes, width: int) -> str:
    """Type, size, and mean, spread and entropy of the samples."""
    import numpy as np

    counts = np.bincount(np.frombuffer(samples, np.uint8), minlength=256)
    share = counts[counts > 0] / max(1, len(samples))
    level = np.arange(256)
    mean = float(counts @ level) / max(1, len(samples))
    spread = max(0.0, float(counts @ level**2) / max(1, len(samples)) - mean**2) ** 0.5
    bits = abs(float(share @ np.log2(share)))
    return f"{kind} {width}x{len(samples) // max(1, width)} mean={mean:.4f} sd={spread:.4f} bits={bits:.4f}"


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_blocks(batches, "text", 8 << 20):
        ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
        n, blobs = [], []
        for text in texts:
            data = (text or "").encode("utf-8", "surrogatepass")
            n.append(len(data))
            blobs.append(encode_png(data + b"\xff" * (-len(data) % ROW or (0 if data else ROW))))
        kinds = pa.array([OTHER] * len(n))
        yield pa.record_batch([ids, pa.array(n, pa.int64()), kinds, pa.array(blobs, pa.binary())], names=["doc_id", "n_bytes", "declared", "media"])


def store_texts(documents: DataFrame) -> DataFrame:
    """(doc_id, text) to (doc_id, n_bytes, declared, media): each text's UTF-8
    bytes, padded by 255, as one grey PNG under an uninformative type.

    A null text counts as empty and is padded to one line; repeated rows stay;
    further columns are ignored; equal texts give equal media.
    """
    return arrow_map(documents.select("doc_id", "text"), _store, "doc_id long, n_bytes long, declared string, media binary")


READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, declared string, media_type string, n_media long"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in READ.split(", ")]
    for batch in text_blocks(batches, "media", 8 << 20):
        rows = []
        for doc, n, declared, blob in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "declared", "media"))):
            blob = blob or b""
            found = carve(blob)
            start, end, kind = found[0] if found else (0, len(blob), OTHER)
            width, payload = samples_of(kind, blob[start:end]) or (end - start, blob[start:end])
            rows.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(blob), hashlib.sha256(blob).hexdigest(), feature_of(kind, payload, width), declared, kind, len(found)))
        kinds = [{"long": pa.int64(), "string": pa.string()}[x.split()[1]] for x in READ.split(", ")]
        yield pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def read_media(stored: DataFrame) -> DataFrame:
    """Reads stored media back: carves the blob by its signatures, corrects
    the declared type, decodes the samples and computes digests and features.

    stored (doc_id, n_bytes, declared, media); one row per input row. The
    first medium of a blob counts. Its samples are those of a grey 8-bit PNG,
    whatever its line filters; of other media, and of a blob that holds none,
    the bytes themselves. Null and empty blobs have no samples, the type
    octet-stream and n_media 0. Repeated rows and null ids stay; further
    columns are ignored; no rows give no rows.
    """
    return arrow_map(stored.select("doc_id", "n_bytes", "declared", "media"), _read, READ)


def _sniffed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("type", pa.string())]))
    for batch in text_blocks(batches, "media", 8 << 20):
        blobs = [x or b"" for x in batch.column("media").to_pylist()]
        parts = [[dict(zip(("start", "end", "type"), x)) for x in carve(b)] for b in blobs]
        yield pa.record_batch([batch.column("id"), batch.column("declared"), pa.array(map(sniff, blobs), pa.string()), pa.array(parts, kind)], names=["id", "declared", "media_type", "parts"])


def sniff_media(media: DataFrame) -> DataFrame:
    """(id, declared, media) to (id, declared, media_type, parts): the type by
    content, and the extent of every medium in the blob, embedded ones too.
    A null or empty blob is an octet-stream without parts."""
    return arrow_map(media.select("id", "declared", "media"), _sniffed, "id long, declared string, media_type string, parts array<struct<start:long,end:long,type:string>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_media(store_texts(table(spark, sf_dir, "documents", "doc_id", "text")))
