"""Words and word shingles of whole texts as 64-bit hashes, by numpy over a batch.

A task walks an Arrow batch in pieces of about a megabyte of text and hashes these in
runs of a quarter of it, so its memory follows the piece (or one long text), not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Fixed constants of the splitmix64 finaliser.
_M1, _M2, _GOLD = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0x9E3779B97F4A7C15)
_PRIME = U(0x100000001B3)
PIECE_BYTES, RUN_BYTES = 1 << 20, 1 << 18

#: Bytes that part words: space and 0x09 to 0x0D.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Any ASCII byte that is no letter or digit; bytes of other scripts count as letters.
MARKS = np.zeros(256, bool)
MARKS[:128] = [not chr(i).isalnum() for i in range(128)]
#: A-Z to lower case, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U(30))) * _M1
    x = (x ^ (x >> U(27))) * _M2
    return x ^ (x >> U(31))


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, int]:
    byte = mix((np.arange(256, dtype=U) + U(1)) * _GOLD)
    return byte, pow(int(_PRIME), -1, 1 << 64)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _PRIME), np.full(n, U(_tables()[1]))
    up[0] = down[0] = U(1)
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def word_hashes(buf: np.ndarray, seps: np.ndarray = SPACES, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Start offset and hash of each word in bytes that end with a separator."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, U)
    if lower:
        buf = LOWER[buf]
    gap = seps[buf]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).view(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    n = 1 << max(18, int(len(buf)).bit_length())
    up, down = _powers(n)
    sums = np.zeros(len(buf) + 1, U)
    np.cumsum(_tables()[0][buf] * up[: len(buf)], out=sums[1:])
    return starts, mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U) * _GOLD)


def pieces(batch: pa.RecordBatch, column: int, piece_bytes: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about so many bytes of a text column, or of one text if it is longer."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    first = 0
    while first < len(ends):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + piece_bytes, "right")))
        yield batch.slice(first, last - first)
        first = last


def _runs(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= RUN_BYTES:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def doc_words(texts: list, seps: np.ndarray = SPACES, lower: bool = True) -> Iterator[tuple[int, np.ndarray]]:
    """For each text (str, bytes or None): its index and word hashes in order."""
    raw = [t if isinstance(t, bytes) else (t or "").encode("utf-8", "surrogatepass") for t in texts]
    raw = [t or b"" for t in raw]
    for a, b in _runs(raw):
        lengths = np.array([len(t) + 1 for t in raw[a:b]])
        offsets = np.concatenate(([0], np.cumsum(lengths)))
        buf = np.frombuffer(b" ".join(raw[a:b]) + b" ", np.uint8)
        starts, hashes = word_hashes(buf, seps, lower)
        cut = np.searchsorted(starts, offsets)
        for i in range(a, b):
            yield i, hashes[cut[i - a] : cut[i - a + 1]]


def shingles(words: np.ndarray, k: int, distinct: bool = True) -> np.ndarray:
    """Hashes of the k-word shingles; the whole sequence as one if it has fewer words; none without words."""
    m = len(words)
    if not m:
        return np.zeros(0, U)
    width = min(k, m)
    acc = words[: m - width + 1] + U(width)
    for j in range(1, width):
        acc = mix(acc * _GOLD + words[j : m - width + 1 + j])
    acc = mix(acc)
    return np.unique(acc) if distinct else acc


def doc_shingles(texts: list, k: int, seps: np.ndarray = SPACES, lower: bool = True) -> Iterator[tuple[int, np.ndarray]]:
    """For each text: its index and sorted distinct shingle hashes."""
    for i, words in doc_words(texts, seps, lower):
        yield i, shingles(words, k)
