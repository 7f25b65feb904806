"""Media columns: signature sniffing, type correction and carving.

``store_media`` keeps a payload losslessly, padded with zero bytes to a positive
multiple of 64, in one of four containers chosen by the payload's checksum: the 8-bit
samples of a mono WAVE file, an 8-bit grey PNG or BMP image 64 pixels wide, or a gzip
member. A WAVE file also carries a cover in a chunk of its own, a PNG of the payload's
last 64 bytes. The declared type is wrong for a quarter of the payloads (by another
part of the checksum), as upload forms and servers get it wrong.

``sniff`` looks at the bytes of a media file alone: an Aho-Corasick automaton finds
every signature, and every mark that ends a format, in one pass; a validator per format
confirms structure and length at each signature; the file confirmed at offset 0 gives
the true type, which replaces a wrong declared one and says how the payload is read;
confirmed files further in are carved as embedded media.

Formats and what their validators walk: wave (RIFF chunks up to the RIFF length),
png (chunks with their CRCs up to IEND), gif (blocks up to the trailer), jpeg
(segments up to EOI), bmp (header lengths), pdf (header to the last %%EOF), gzip
(a whole member inflates and its CRC and length agree), zip (end record whose
directory lies where it says). Ends of pdf and zip are looked up among the marks, so a
file full of their signatures is still read once.

Nulls: a null payload counts as empty when stored, a null doc_id stays null; sniffing a
null gives type "empty". A file whose signature is right but whose structure is not
keeps the type "unknown". Equal texts have equal files and rows; columns besides doc_id
and the text are left out; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAD = 64
RATE = 8000

#: The formats' signatures, each with its distance from the file's start.
SIGNATURES = (
    (b"RIFF", 0, "wave"),
    (b"\x89PNG\r\n\x1a\n", 0, "png"),
    (b"GIF87a", 0, "gif"),
    (b"GIF89a", 0, "gif"),
    (b"\xff\xd8\xff", 0, "jpeg"),
    (b"BM", 0, "bmp"),
    (b"%PDF-", 0, "pdf"),
    (b"\x1f\x8b\x08", 0, "gzip"),
    (b"PK\x03\x04", 0, "zip"),
)
#: Marks that end a format.
MARKS = (b"%%EOF", b"startxref", b"PK\x05\x06")
MIME = {"wave": "audio/wav", "png": "image/png", "gif": "image/gif", "jpeg": "image/jpeg", "bmp": "image/bmp", "pdf": "application/pdf", "gzip": "application/gzip", "zip": "application/zip", "unknown": "application/octet-stream", "empty": "application/x-empty"}


def padded(payload: bytes) -> bytes:
    """payload with zero bytes up to a positive multiple of PAD."""
    return payload + b"\0" * (-len(payload) % PAD if payload else PAD)


def _riff_chunk(name: bytes, content: bytes) -> bytes:
    return name + struct.pack("<I", len(content)) + content + b"\0" * (len(content) & 1)


def wave_of(samples: bytes, rate: int = RATE, cover: bytes = b"") -> bytes:
    """A mono WAVE file of 8-bit samples, with a cover image in a chunk "cove" if one is given."""
    body = b"WAVE" + _riff_chunk(b"fmt ", struct.pack("<HHIIHH", 1, 1, rate, rate, 1, 8)) + _riff_chunk(b"data", samples)
    body += _riff_chunk(b"cove", cover) if cover else b""
    return b"RIFF" + struct.pack("<I", len(body)) + body


def wave_samples(media: bytes) -> bytes:
    """The samples of the data chunks of a WAVE file."""
    out, at, end = [], 12, 8 + struct.unpack_from("<I", media, 4)[0]
    while at + 8 <= end:
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"data":
            out.append(media[at + 8 : at + 8 + size])
        at += 8 + size + (size & 1)
    return b"".join(out)


def png_of(pixels: bytes, width: int = PAD) -> bytes:
    """An 8-bit grey PNG of whole rows."""
    chunk = lambda name, content: struct.pack(">I", len(content)) + name + content + struct.pack(">I", zlib.crc32(name + content))
    rows = b"".join(b"\0" + pixels[k : k + width] for k in range(0, len(pixels), width))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(pixels) // width, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows, 1)) + chunk(b"IEND", b"")


def png_pixels(media: bytes) -> bytes | None:
    """The pixels of an 8-bit grey PNG whose rows have no filter; None for other kinds."""
    width, height, depth, colour, _, _, interlaced = struct.unpack_from(">IIBBBBB", media, 16)
    parts, at = [], 8
    while at + 8 <= len(media):
        size = struct.unpack_from(">I", media, at)[0]
        if media[at + 4 : at + 8] == b"IDAT":
            parts.append(media[at + 8 : at + 8 + size])
        at += 12 + size
    if (depth, colour, interlaced) != (8, 0, 0):
        return None
    rows = zlib.decompress(b"".join(parts))
    if len(rows) != height * (width + 1) or any(rows[:: width + 1]):
        return None
    return b"".join(rows[k + 1 : k + 1 + width] for k in range(0, len(rows), width + 1))


def bmp_of(pixels: bytes, width: int = PAD) -> bytes:
    """An 8-bit BMP with a grey palette; rows stand from the top down (negative height) and need no padding at widths divisible by four."""
    palette = b"".join(bytes((k, k, k, 0)) for k in range(256))
    offset = 54 + len(palette)
    head = struct.pack("<IiiHHIIiiII", 40, width, -(len(pixels) // width), 1, 8, 0, len(pixels), 2835, 2835, 256, 0)
    return b"BM" + struct.pack("<IHHI", offset + len(pixels), 0, 0, offset) + head + palette + pixels


def bmp_pixels(media: bytes) -> bytes | None:
    """The pixel bytes of an uncompressed 8-bit BMP, rows from the top down; None for other kinds."""
    offset, _, width, height, _, bits, packing = struct.unpack_from("<IIiiHHI", media, 10)
    if bits != 8 or packing:
        return None
    line = (width + 3) // 4 * 4
    rows = [media[offset + k * line : offset + k * line + width] for k in range(abs(height))]
    return b"".join(rows if height < 0 else rows[::-1])


def gzip_of(raw: bytes) -> bytes:
    """One gzip member without time and name."""
    d = zlib.compressobj(1, zlib.DEFLATED, 31)
    return d.compress(raw) + d.flush()


CONTAINERS = {"wave": lambda x: wave_of(x, cover=png_of(x[-PAD:], 8)), "png": png_of, "bmp": bmp_of, "gzip": gzip_of}
READERS = {"wave": wave_samples, "png": png_pixels, "bmp": bmp_pixels, "gzip": lambda b: zlib.decompress(b, 31)}


def stored_as(payload: bytes) -> tuple[str, bytes]:
    """(declared type, file) of a payload."""
    check = zlib.crc32(payload)
    kind = tuple(CONTAINERS)[check % 4]
    wrong = ("image/jpeg", "application/pdf", "audio/mpeg", "text/plain")[check // 16 % 4]
    return MIME[kind] if check // 4 % 4 else wrong, CONTAINERS[kind](payload)


def _wave(b: bytes, at: int) -> int:
    if len(b) < at + 12 or b[at + 8 : at + 12] != b"WAVE":
        return 0
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    if end > len(b):
        return 0
    p, seen = at + 12, set()
    while p + 8 <= end:
        seen.add(b[p : p + 4])
        size = struct.unpack_from("<I", b, p + 4)[0]
        p += 8 + size + (size & 1)
    return end - at if p == end and {b"fmt ", b"data"} <= seen else 0


def _png(b: bytes, at: int) -> int:
    p = at + 8
    first = True
    while p + 12 <= len(b):
        size = struct.unpack_from(">I", b, p)[0]
        name = b[p + 4 : p + 8]
        if p + 12 + size > len(b) or (first and name != b"IHDR") or zlib.crc32(b[p + 4 : p + 8 + size]) != struct.unpack_from(">I", b, p + 8 + size)[0]:
            return 0
        p, first = p + 12 + size, False
        if name == b"IEND":
            return p - at
    return 0


def _gif(b: bytes, at: int) -> int:
    if len(b) < at + 13:
        return 0
    flags = b[at + 10]
    p = at + 13 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0)

    def blocks(p: int) -> int:
        while p < len(b) and b[p]:
            p += 1 + b[p]
        return p + 1

    while p < len(b):
        if b[p] == 0x3B:
            return p + 1 - at
        if b[p] == 0x21:
            p = blocks(p + 2)
        elif b[p] == 0x2C and p + 10 < len(b):
            flags = b[p + 9]
            p = blocks(p + 10 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0) + 1)
        else:
            return 0
    return 0


def _jpeg(b: bytes, at: int) -> int:
    p = at + 2
    while p + 4 <= len(b) and b[p] == 0xFF:
        mark = b[p + 1]
        if mark == 0xFF:
            p += 1
            continue
        if mark == 0xD9:
            return p + 2 - at
        size = struct.unpack_from(">H", b, p + 2)[0]
        if size < 2 or not 0xC0 <= mark <= 0xFE:
            return 0
        p += 2 + size
        if mark == 0xDA:  # entropy-coded data up to the next marker that is no restart or stuffed byte
            while True:
                p = b.find(b"\xff", p)
                if p < 0 or p + 1 >= len(b):
                    return 0
                if b[p + 1] == 0 or 0xD0 <= b[p + 1] <= 0xD7:
                    p += 2
                    continue
                break
    return p + 2 - at if b[p : p + 2] == b"\xff\xd9" else 0


def _bmp(b: bytes, at: int) -> int:
    if len(b) < at + 30:
        return 0
    size, _, offset, head, width, height, planes, bits = struct.unpack_from("<IIIIiiHH", b, at + 2)
    rows = (width * bits + 31) // 32 * 4 * abs(height)
    plausible = head in (40, 52, 56, 108, 124) and planes == 1 and bits in (1, 4, 8, 16, 24, 32) and width > 0 and height != 0
    return size if plausible and at + size <= len(b) and 14 + head <= offset and offset + rows <= size else 0


def _gzip(b: bytes, at: int) -> int:
    d, view, p = zlib.decompressobj(31), memoryview(b), at
    try:
        while p < len(b) and not d.eof:
            rest = view[p : p + (1 << 16)]
            p += len(rest)
            while len(rest) and not d.eof:
                d.decompress(rest, 1 << 20)
                rest = d.unconsumed_tail
    except zlib.error:
        return 0
    return p - len(d.unused_data) - at if d.eof else 0


class _Marks:
    """The places of the marks in a file, in order, and the starts that the end records of zips name."""

    def __init__(self, b: bytes, places: dict[bytes, list[int]]):
        self.eof, self.xref = places[b"%%EOF"], places[b"startxref"]
        self.zip_ends: dict[int, int] = {}
        for end in places[b"PK\x05\x06"]:
            if end + 22 <= len(b):
                size, offset, comment = struct.unpack_from("<IIH", b, end + 12)
                start = end - size - offset
                if start >= 0 and b[end - size : end - size + 4] in (b"PK\x01\x02", b"PK\x05\x06"):
                    self.zip_ends.setdefault(start, end + 22 + comment)

    def pdf(self, at: int) -> int:
        k = bisect_right(self.xref, at)
        return self.eof[-1] + 5 - at if self.eof and k < len(self.xref) and self.xref[k] < self.eof[-1] else 0

    def zip(self, at: int) -> int:
        return max(0, self.zip_ends.get(at, at) - at)


VALIDATORS = {"wave": _wave, "png": _png, "gif": _gif, "jpeg": _jpeg, "bmp": _bmp, "gzip": _gzip}


def _automaton() -> ahocorasick.Automaton:
    """Signatures and marks as Latin-1 strings: one character per byte."""
    a = ahocorasick.Automaton()
    for k, (magic, _, _) in enumerate(SIGNATURES):
        a.add_word(magic.decode("latin-1"), k)
    for k, mark in enumerate(MARKS):
        a.add_word(mark.decode("latin-1"), ~k)
    a.make_automaton()
    return a


AUTOMATON = _automaton()


def sniff_bytes(media: bytes | None) -> tuple[str, int, list[tuple[str, int, int]]]:
    """(type, length, embedded (type, offset, length)) by signature and structure.

    Hits inside a confirmed embedded file are its own and not carved again; what a gzip
    member holds is packed and not looked into.
    """
    if not media:
        return "empty", 0, []
    hits, places = [], {mark: [] for mark in MARKS}
    for last, k in AUTOMATON.iter(media.decode("latin-1")):
        if k < 0:
            places[MARKS[~k]].append(last - len(MARKS[~k]) + 1)
        else:
            hits.append((last - len(SIGNATURES[k][0]) + 1 - SIGNATURES[k][1], SIGNATURES[k][2]))
    marks = _Marks(media, places)
    whole, length, carved, skip = "unknown", 0, [], 0
    for at, kind in hits:
        if at and at < skip:
            continue
        size = getattr(marks, kind)(at) if kind in ("pdf", "zip") else VALIDATORS[kind](media, at)
        if not size:
            continue
        if at == 0:
            whole, length = kind, size
            skip = size if kind == "gzip" else 0
        else:
            carved.append((kind, at, size))
            skip = at + size
    return whole, length, carved


def payload_of(media: bytes | None, kind: str) -> bytes | None:
    """The payload of a file of the sniffed kind; None where that kind has no reader or the file is of a sort that it does not read."""
    return READERS[kind](media) if kind in READERS else None


def store_media(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, declared, media): every text's UTF-8 bytes, padded, as a media file."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            raw = [(x or "").encode("utf-8", "surrogatepass") for x in pdf["text"]]
            files = [stored_as(padded(x)) for x in raw]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_bytes": list(map(len, raw)), "declared": [d for d, _ in files], "media": [m for _, m in files]})

    source = docs.select(F.col("doc_id").cast("long").cast("string"), F.col(text).cast("string").alias("text"))
    return _numbered(source.mapInPandas(rows, "doc_id string, n_bytes long, declared string, media binary"))


def _numbered(df: DataFrame) -> DataFrame:
    """Ids travel through pandas as strings, as beside a null it would make floats of them; here they are numbers again."""
    return df.withColumn("doc_id", F.col("doc_id").cast("long"))


def sniff(media: DataFrame, declared: str | None = None) -> DataFrame:
    """(doc_id, declared, sniffed, corrected, length, carved, media, payload) of a media column.

    media has doc_id and media; ``declared`` names the column of declared types (none:
    application/octet-stream). corrected says that the declared type was not the one
    found; carved lists (type, offset, length, content); payload is what a confirmed
    file holds, null for kinds without a reader.
    """
    schema = "doc_id string, declared string, sniffed string, corrected boolean, length long, carved array<struct<type:string,offset:long,length:long,content:binary>>, media binary, payload binary"

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc_id, said, b in zip(pdf["doc_id"], pdf["declared"], pdf["media"], strict=True):
                kind, length, carved = sniff_bytes(b)
                parts = [{"type": MIME[k], "offset": at, "length": size, "content": b[at : at + size]} for k, at, size in carved]
                out.append((doc_id, said, MIME[kind], MIME[kind] != said, length, parts, b, payload_of(b, kind)))
            yield pd.DataFrame(out, columns=["doc_id", "declared", "sniffed", "corrected", "length", "carved", "media", "payload"])

    said = F.col(declared) if declared else F.lit(MIME["unknown"])
    return _numbered(media.select(F.col("doc_id").cast("string"), said.alias("declared"), "media").mapInPandas(rows, schema))


def digests(media: DataFrame) -> DataFrame:
    """The contract's digest of each stored file (doc_id, n_bytes, declared, media), all from the bytes read back as what they are sniffed to be.

    feature names the sniffed type, the declared one where it was wrong, the length,
    and mean and distinct values of the payload; carved are the embedded files.
    """
    schema = "doc_id string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, corrected boolean, carved string"

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc_id, n, said, b in zip(pdf["doc_id"], pdf["n_bytes"], pdf["declared"], pdf["media"], strict=True):
                kind, length, carved = sniff_bytes(b)
                payload = payload_of(b, kind) or b""
                counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
                mean = int(counts @ np.arange(256)) / max(1, len(payload))
                feature = ";".join([MIME[kind], *[f"declared={said}"] * (said != MIME[kind]), f"length={length}", f"mean={mean:.4f}", f"distinct={np.count_nonzero(counts)}"])
                found = ",".join(f"{MIME[k]}@{at}+{size}" for k, at, size in carved)
                out.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:]), len(b), hashlib.sha256(b).hexdigest(), feature, said != MIME[kind], found))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in schema.split(", ")])

    return _numbered(media.select(F.col("doc_id").cast("string"), "n_bytes", "declared", "media").mapInPandas(rows, schema))
