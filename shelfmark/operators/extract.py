"""Facts from file contents (E1-E5) and hashes of raw bytes (V1-V3).

Contents come from ``spark.read.format("binaryFile")`` or any table with
file_id, extension and content; the work is a vectorised Python function over
Arrow batches, for the formats are binary. Only a bounded head of a file is read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes that are looked at, and extensions by extractor.
HEAD, IMAGE_HEAD = 2 << 20, 4 << 20
EXTRACTED = ("pdf", "jpg", "jpeg", "zip", "mp3", "id3")
IMAGES = ("jpg", "jpeg", "png", "gif", "webp", "bmp", "heic")
#: Text frames of an ID3 tag and the keys they give.
FRAMES = {b"TIT2": "title", b"TPE1": "artist", b"TALB": "album"}
DATE = re.compile(rb"[0-9]{4}:[0-9]{2}:[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}")
ESCAPES = {"n": "\n", "r": "\r", "t": "\t"}
Fact = tuple[str, str, str, float]


def _clean(text: str) -> str | None:
    return text.strip("\0").strip() or None


def pdf_facts(data: bytes) -> list[Fact]:
    """The title: the first parenthesised literal after /Title, with its escapes."""
    text = data.decode("utf-8", "replace")
    at = text.find("/Title")
    begin = text.find("(", at + 6) if at >= 0 else -1
    if begin < 0:
        return []
    literal = re.match(r"(?:[^\\)]|\\.)*", text[begin + 1 :], re.S)[0]
    value = _clean(re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), literal, flags=re.S))
    return [("title", value, "extractor:pdf", 0.9)] if value else []


def jpeg_facts(data: bytes) -> list[Fact]:
    """The first date and time written in ASCII."""
    found = DATE.search(data) if data.startswith(b"\xff\xd8") else None
    return [("capturedAt", found[0].decode(), "extractor:exif", 0.85)] if found else []


def zip_facts(data: bytes) -> list[Fact]:
    """Entry count of the last end record that is whole, and where the file comes from."""
    at = data.rfind(b"PK\x05\x06")
    if at < 0 or at + 22 > len(data):
        return []
    source = "extractor:zip-central-directory"
    return [("archiveEntryCount", str(int.from_bytes(data[at + 10 : at + 12], "little")), source, 1.0), ("origin", "archive-extracted", source, 0.5)]


def _size(raw: bytes) -> int | None:
    """Four bytes of seven bits each."""
    return None if any(b & 0x80 for b in raw) else sum(b << s for b, s in zip(raw, (21, 14, 7, 0), strict=True))


def _frame_text(raw: bytes) -> str | None:
    encoding, body = raw[0], raw[1:]
    if encoding in (0, 3):
        return _clean(body.decode("utf-8", "replace"))
    if encoding in (1, 2):
        body = body.removeprefix(b"\xff\xfe").removeprefix(b"\xfe\xff")
        return _clean(body[: len(body) // 2 * 2].decode("utf-16-le", "replace"))
    return None


def id3_facts(data: bytes) -> list[Fact]:
    """Title, artist and album of an ID3v2 tag (E5)."""
    if len(data) < 10 or data[:3] != b"ID3":
        return []
    end, at, out = min(10 + (_size(data[6:10]) or 0), len(data)), 10, []
    while at + 10 <= end and data[at : at + 4] != b"\0\0\0\0":
        name, raw = data[at : at + 4], data[at + 4 : at + 8]
        size = _size(raw)
        size = int.from_bytes(raw, "big") if size is None else size
        at += 10
        if not size or at + size > end:
            break
        if name in FRAMES and (value := _frame_text(data[at : at + size])):
            out.append((FRAMES[name], value, "extractor:id3", 0.9))
        at += size
    return out


READERS = {"pdf": pdf_facts, "jpg": jpeg_facts, "jpeg": jpeg_facts, "zip": zip_facts, "mp3": id3_facts, "id3": id3_facts}
FACTS = "entity_id long, key string, value string, source string, confidence double"


def extracted_facts(files: DataFrame) -> DataFrame:
    """Facts in the contents of files (file_id, extension, content) (E1); null contents give nothing."""
    rows = files.filter(F.lower("extension").isin(*EXTRACTED) & F.col("content").isNotNull())
    rows = rows.select("file_id", F.lower("extension").alias("extension"), F.substring("content", 1, HEAD).alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(i, *fact) for i, kind, data in zip(*(c.to_pylist() for c in batch.columns), strict=True) for fact in READERS[kind](data)]
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["entity_id", "key", "value", "source", "confidence"])

    return rows.mapInArrow(run, FACTS).withColumn("confidence", F.col("confidence").cast("float").cast("double"))


def displayed_facts(found: DataFrame, sensitive: DataFrame) -> DataFrame:
    """Extracted facts, not displayed for entities whose resolved sensitivity is private or restricted."""
    hidden = sensitive.filter("key = 'sensitivity' AND confidence >= 0.5 AND value IN ('private', 'restricted')").select("entity_id", F.lit(True).alias("hidden")).distinct()
    return found.join(hidden, "entity_id", "left").withColumn("display", F.col("hidden").isNull()).drop("hidden")


def bucket_means(data: bytes, buckets: int) -> np.ndarray:
    """Whole means of the bytes of equal stretches, of one byte at least."""
    n = len(data)
    edges = np.arange(buckets + 1) * n // buckets
    start, end = edges[:-1], np.minimum(np.maximum(edges[1:], edges[:-1] + 1), n)
    sums = np.concatenate(([0], np.cumsum(np.frombuffer(data, np.uint8), dtype=np.int64)))
    return (sums[end] - sums[start]) // (end - start)


def _packed(bits: np.ndarray) -> int:
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def average_hash(data: bytes) -> int:
    """Bit i tells whether the i-th of 64 stretches is at least as bright as all on average (V2)."""
    means = bucket_means(data, 64)
    return _packed(means >= means.sum() // 64)


def difference_hash(data: bytes) -> int:
    """Bit i tells whether the i-th of 65 stretches is no brighter than the next (V3)."""
    means = bucket_means(data, 65)
    return _packed(means[1:] >= means[:-1])


def image_hashes(files: DataFrame) -> DataFrame:
    """(id, a, b): average and difference hash of the raw bytes of images (V1); empty ones give nothing."""
    rows = files.filter(F.lower(F.coalesce("extension", F.lit(""))).isin(*IMAGES) & (F.length("content") > 0))
    rows = rows.select("file_id", F.substring("content", 1, IMAGE_HEAD).alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([average_hash(d) for d in data], pa.int64()), pa.array([difference_hash(d) for d in data], pa.int64())], names=["id", "a", "b"])

    return rows.mapInArrow(run, "id long, a long, b long")
