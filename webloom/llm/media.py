"""Media columns: signature sniffing, structural validation, type correction and carving.

An Aho-Corasick automaton finds the magic bytes of all formats in one pass over the
bytes; a validator of each format then confirms structure and lengths from there (chunk
tables, checksums, end marks) and gives the length. A confirmed format at offset 0 is the
type of the value, whatever was declared; confirmed formats further inside are carved.

A PDF ends at the first ``%%EOF`` after its first ``startxref``; where these marks stand is
found once for a value, so many signatures in a long value cost no more than one.

Null and empty values have type ``application/octet-stream`` and carve nothing. Equal
values give equal results, so repeated rows agree.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import record_batch, slices

UNKNOWN = "application/octet-stream"
UNIT = 192


def wav(b: memoryview, at: int) -> int:
    """Length of a RIFF/WAVE form at ``at``, 0 if it is none."""
    if len(b) < at + 12 or bytes(b[at + 8 : at + 12]) != b"WAVE":
        return 0
    end, p, format_, data = at + 8 + int.from_bytes(b[at + 4 : at + 8], "little"), at + 12, False, False
    if end > len(b):
        return 0
    while p + 8 <= end:
        size = int.from_bytes(b[p + 4 : p + 8], "little")
        format_ |= bytes(b[p : p + 4]) == b"fmt " and size >= 16
        data |= bytes(b[p : p + 4]) == b"data"
        p += 8 + size + size % 2
    return end - at if format_ and data and p in (end, end + 1) else 0


def png(b: memoryview, at: int) -> int:
    p, first = at + 8, True
    while p + 12 <= len(b):
        size, kind = int.from_bytes(b[p : p + 4], "big"), bytes(b[p + 4 : p + 8])
        if p + 12 + size > len(b) or first != (kind == b"IHDR") or zlib.crc32(b[p + 4 : p + 8 + size]) != int.from_bytes(b[p + 8 + size : p + 12 + size], "big"):
            return 0
        p, first = p + 12 + size, False
        if kind == b"IEND":
            return p - at
    return 0


def gif(b: memoryview, at: int) -> int:
    def blocks(p: int) -> int:
        while p < len(b) and b[p]:
            p += 1 + b[p]
        return p + 1

    if len(b) < at + 13:
        return 0
    p = at + 13 + (3 << (b[at + 10] & 7) + 1 if b[at + 10] & 128 else 0)
    while p < len(b):
        if b[p] == 0x3B:
            return p + 1 - at
        if b[p] == 0x21:
            p = blocks(p + 2)
        elif b[p] == 0x2C and p + 10 < len(b):
            p = blocks(p + 11 + (3 << (b[p + 9] & 7) + 1 if b[p + 9] & 128 else 0))
        else:
            return 0
    return 0


def jpeg(b: memoryview, at: int) -> int:
    p, frame = at + 2, False
    while p + 4 <= len(b) and b[p] == 0xFF:
        mark = b[p + 1]
        if mark == 0xD9:
            return p + 2 - at if frame else 0
        frame |= 0xC0 <= mark <= 0xC3
        p += 2 + int.from_bytes(b[p + 2 : p + 4], "big")
        if mark == 0xDA:
            whole = b.obj
            while (p := whole.find(b"\xff", p)) >= 0 and p + 1 < len(b) and (b[p + 1] == 0 or 0xD0 <= b[p + 1] <= 0xD7):
                p += 2
            if p < 0:
                return 0
    return p + 2 - at if frame and bytes(b[p : p + 2]) == b"\xff\xd9" else 0


def bmp(b: memoryview, at: int) -> int:
    if len(b) < at + 30:
        return 0
    size, pixels, header = struct.unpack_from("<I4xII", b, at + 2)
    planes, depth = struct.unpack_from("<HH", b, at + 26)
    return size if header in (40, 108, 124) and planes == 1 and depth in (1, 4, 8, 16, 24, 32) and 14 + header <= pixels <= size <= len(b) - at else 0


def gzip(b: memoryview, at: int) -> int:
    unpack, p = zlib.decompressobj(31), at
    try:
        while p < len(b) and not unpack.eof:
            part = bytes(b[p : p + 65536])
            unpack.decompress(part, 1 << 20)
            while unpack.unconsumed_tail:
                unpack.decompress(unpack.unconsumed_tail, 1 << 20)
            p += len(part)
    except zlib.error:
        return 0
    return p - len(unpack.unused_data) - at if unpack.eof else 0


@lru_cache(maxsize=1)
def _marks(whole: bytes) -> tuple[list[int], list[int]]:
    """Where ``startxref`` starts and ``%%EOF`` ends."""
    return [m.start() for m in re.finditer(b"startxref", whole)], [m.end() for m in re.finditer(b"%%EOF", whole)]


def pdf(b: memoryview, at: int) -> int:
    tables, ends = _marks(b.obj)
    table = bisect_right(tables, at)
    if not bytes(b[at + 5 : at + 6]).isdigit() or table == len(tables):
        return 0
    end = bisect_right(ends, tables[table] + 9)
    return ends[end] - at if end < len(ends) else 0


def flac(b: memoryview, at: int) -> int:
    """Only at the start can its length be told: it runs to the end of the value."""
    return len(b) - at if len(b) >= at + 42 and b[at + 4] & 127 == 0 and int.from_bytes(b[at + 5 : at + 8], "big") == 34 else 0


def ogg(b: memoryview, at: int) -> int:
    p = at
    while p + 27 <= len(b) and bytes(b[p : p + 5]) == b"OggS\0":
        n = b[p + 26]
        size = 27 + n + sum(b[p + 27 : p + 27 + n])
        if p + size > len(b):
            return 0
        last, p = b[p + 5] & 4, p + size
        if last:
            return p - at
    return 0


#: Magic bytes, media type, validator.
FORMATS: tuple[tuple[bytes, str, Callable[[memoryview, int], int]], ...] = (
    (b"RIFF", "audio/wav", wav),
    (b"\x89PNG\r\n\x1a\n", "image/png", png),
    (b"GIF87a", "image/gif", gif),
    (b"GIF89a", "image/gif", gif),
    (b"\xff\xd8\xff", "image/jpeg", jpeg),
    (b"BM", "image/bmp", bmp),
    (b"\x1f\x8b\x08", "application/gzip", gzip),
    (b"%PDF-", "application/pdf", pdf),
    (b"fLaC", "audio/flac", flac),
    (b"OggS\0", "audio/ogg", ogg),
)


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    built = ahocorasick.Automaton()
    for magic, kind, check in FORMATS:
        built.add_word(magic.decode("latin-1"), (len(magic), kind, check))
    built.make_automaton()
    return built


def sniffed(value: bytes) -> list[tuple[int, int, str]]:
    """(offset, length, type) of confirmed formats in order; one inside another is listed too."""
    whole = memoryview(value)
    found = []
    for last, (size, kind, check) in automaton().iter(value.decode("latin-1")):
        at = last + 1 - size
        if length := check(whole, at):
            found.append((at, length, kind))
    return sorted(found)


def corrected(declared: str | None, value: bytes) -> tuple[str, bool, list[tuple[int, int, str]]]:
    """Type, whether the declared one was wrong, and what is embedded."""
    found = sniffed(value)
    own = next((kind for at, _, kind in found if at == 0), declared if declared and not any(declared == k for _, k, _ in FORMATS) else UNKNOWN)
    return own, own != declared, [x for x in found if x[0]]


def stored(payload: bytes, rate: int = 8000) -> bytes:
    """8-bit mono PCM in a RIFF form."""
    return b"RIFF" + struct.pack("<I", 36 + len(payload)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload


def samples(form: bytes) -> bytes:
    """The bytes of the data chunk, found by walking the chunks."""
    p = 12
    while form[p : p + 4] != b"data":
        size = int.from_bytes(form[p + 4 : p + 8], "little")
        p += 8 + size + size % 2
    return form[p + 8 : p + 8 + int.from_bytes(form[p + 4 : p + 8], "little")]


#: How a stored value of a sniffed type gives its payload back.
READERS = {"audio/wav": samples}


def media_row(text: str | None, declared: str | None = None) -> dict[str, object]:
    declared = declared or UNKNOWN
    raw = (text or "").encode("utf-8", "surrogatepass")
    form = stored(raw + b" " * (-len(raw) % UNIT or (0 if raw else UNIT)))
    kind, wrong, inner = corrected(declared, form)
    payload = READERS[kind](form)
    mean = sum(payload) // len(payload)
    feature = f"{kind};pcm_u8;samples={len(payload)};mean={mean};declared={declared};corrected={str(wrong).lower()};embedded={','.join(f'{k}@{a}+{n}' for a, n, k in inner)}"
    return {
        "n_bytes": len(raw), "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-16:]),
        "media_bytes": len(form), "media_sha256": hashlib.sha256(form).hexdigest(), "feature": feature,
    }


_MEDIA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])
MEDIA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_columns(docs: DataFrame, declared: str | None = None) -> DataFrame:
    """Texts stored as 8-bit samples, read back by their sniffed type and described; one row per document.

    ``declared`` names a column of media types that the rows declare; without it, or where
    it is null, nothing is declared (application/octet-stream).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [media_row(t, d) for t, d in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield record_batch(_MEDIA, doc_id=batch.column(0), **{n: [r[n] for r in rows] for n in _MEDIA.names[1:]})

    said = F.col(declared).cast("string") if declared else F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("long"), "text", said.alias("said")).mapInArrow(run, MEDIA)


TYPED = ("media_type", "was_wrong", "carved")


def typed(media: DataFrame, content: str = "content", declared: str = "declared") -> DataFrame:
    """Adds to rows of binary ``content``: media_type, was_wrong, carved (offset, length, type and bytes).

    Columns of ``media`` with these names are replaced, unless they are ``content`` or
    ``declared`` themselves: those are an error, as the result couldn't hold both.
    """
    if {content, declared} & set(TYPED):
        raise ValueError(f"content and declared can't be columns named {', '.join(TYPED)}")
    kept = media.select(*[F.col(f"`{c}`") for c in media.columns if c not in TYPED])
    names = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("media_type", pa.string()), ("content", pa.binary())]))
        for batch in slices(batches, 32):
            values = [v or b"" for v in batch.column(names.index(content)).to_pylist()]
            out = [corrected(d, v) for v, d in zip(values, batch.column(names.index(declared)).to_pylist(), strict=True)]
            carved = [[{"offset": a, "length": n, "media_type": k, "content": v[a : a + n]} for a, n, k in o[2]] for v, o in zip(values, out, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([o[0] for o in out]), pa.array([o[1] for o in out]), pa.array(carved, kind)], names=[*names, *TYPED])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(run, f"{fields}, media_type string, was_wrong boolean, carved array<struct<offset:bigint,length:bigint,media_type:string,content:binary>>")
