"""Hashes within a number of bits of one another, by chunks that meet in tasks.

Where the wanted distance is a large part of the bits, no band of them tells near
hashes from others, and a join on bands meets more pairs than there are. Then all
pairs are compared, n^2 / 2 of them: hashes are dealt into chunks, each two
chunks meet in one task, by runs of BLOCK_WORDS comparisons. A task holds two chunks of
CHUNK hashes about, whatever the input, and gives what it finds as it goes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.sources import shared

#: Hashes of a chunk; up to CHUNKS chunks are smaller, of LEAST hashes or more, so that small tables fill several tasks.
CHUNK, CHUNKS, LEAST = 1 << 15, 16, 1 << 10
BLOCK_WORDS, OUT_ROWS = 1 << 17, 1 << 16
Side = tuple[np.ndarray, np.ndarray, np.ndarray]


def close(left: Side, right: Side, same: bool, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, distance) of rows (id, a, b) of two chunks at most so many bits apart, in runs; of one chunk with itself i < j."""
    (_, la, lb), (_, ra, rb) = left, right
    wide = bool(lb.any() or rb.any())
    step, at = max(1, BLOCK_WORDS // max(1, len(ra))), 0
    while at < len(la):
        first = at if same else 0
        d = np.bitwise_count(la[at : at + step, None] ^ ra[None, first:])
        if wide:
            d += np.bitwise_count(lb[at : at + step, None] ^ rb[None, first:])
        i, j = np.divmod(np.flatnonzero(d <= most), d.shape[1])
        if same:
            i, j = i[i < j], j[i < j]
        yield i + at, j + first, d[i, j]
        at += step


def joining(found: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], n_left: int, n_right: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of the runs found those pairs only that connect what earlier ones don't."""
    parent = np.arange(n_left if same else n_left + n_right)
    shift = 0 if same else n_left
    for i, j, d in found:
        keep = np.flatnonzero(parent[i] != parent[j + shift])
        links = []
        for k, x, y in zip(keep.tolist(), i[keep].tolist(), (j[keep] + shift).tolist(), strict=True):
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            while parent[y] != y:
                parent[y] = y = parent[parent[y]]
            if x != y:
                parent[max(x, y)] = min(x, y)
                links.append(k)
        if links:
            while (parent[parent] != parent).any():
                parent = parent[parent]
            yield i[links], j[links], d[links]


def _side(rows: pa.ListScalar) -> Side:
    ids, a, b = rows.values.flatten()
    return ids.to_numpy(), a.to_numpy().view(np.uint64), b.to_numpy().view(np.uint64)


def pairs(hashes: DataFrame, most: int, forest: bool = False) -> DataFrame:
    """Pairs (left_id, right_id, distance) of distinct hashes (id, a, b) at most so many bits apart, or enough of them to connect all that these do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                same = batch.column(1)[row].as_py() == batch.column(2)[row].as_py()
                left, right = _side(batch.column(3)[row]), _side(batch.column(4)[row])
                found = close(left, right, same, most)
                held, n = [], 0
                for i, j, d in joining(found, len(left[0]), len(right[0]), same) if forest else found:
                    x, y = left[0][i], right[0][j]
                    held.append((np.minimum(x, y), np.maximum(x, y), d.astype(np.int32)))
                    n += len(i)
                    if n >= OUT_ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names=["left_id", "right_id", "distance"])
                        held, n = [], 0
                if n:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names=["left_id", "right_id", "distance"])

    n = hashes.count()
    chunks = max(1, min(CHUNKS, -(-n // LEAST)), -(-n // CHUNK))
    dealt = hashes.select(F.pmod(F.xxhash64("a", "b"), F.lit(chunks)).alias("chunk"), F.struct(F.col("id").cast("long").alias("id"), "a", "b").alias("r"))
    packed = shared.written(dealt.groupBy("chunk").agg(F.collect_list("r").alias("rows")), "chunks")  # a chunk's rows: about CHUNK
    met = packed.select(F.col("chunk").alias("i"), F.col("rows").alias("left"), F.explode(F.sequence(F.col("chunk"), F.lit(chunks - 1).cast("long"))).alias("j"))
    met = met.join(packed.select(F.col("chunk").alias("j"), F.col("rows").alias("right")), "j")
    spot = (F.expr("j * (j + 1) div 2") + F.col("i")).cast("int")
    dealt_out = met.select(spot.alias("spot"), "i", "j", "left", "right").repartitionById(chunks * (chunks + 1) // 2, F.col("spot"))
    return dealt_out.mapInArrow(run, "left_id long, right_id long, distance int")
