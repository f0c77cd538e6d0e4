"""Operator 10: benchmark decontamination by size-partitioned MinHash containment search.

A short test item inside a long document has a tiny Jaccard similarity, so the
search is on containment: the share of the item's shingles that the document
holds. Items are partitioned by size (powers of two). An item is indexed by the
smallest hashes of its shingles, a bottom-k MinHash sketch whose k belongs to
its size partition: k = u - ceil(t u) + 1 for the partition's largest size u.
With containment t or more, at most n - ceil(t n) shingles of the item are
missing from the document, so one of its k smallest is present: looking up every
shingle of a document among the sketches misses nothing. A partition whose
smallest item needs more shingles than the document has is skipped. Candidates
are verified by exact shingle containment.

The sketches and item shingles go to every task only while their count is within
``most_items_shingles``, which is checked by counting; beyond it, the same search
runs as joins on shingle hashes.

Words are lower-cased runs of letters and digits; shingles have five words, or
all words of an item that has fewer (documents are then searched at that width
too). Defined results: null or wordless texts and items link with nothing;
repeated rows of a document or an item give one link; empty tables give no
links; a null doc_id or item_id is carried as null; very long texts are walked
whole. Extra columns are ignored by ``scan`` and kept by ``remove_contaminated``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm import store, textops

WIDTH, THRESHOLD = 5, 0.8
#: Bound on what is sent to every task: two million 8-byte shingles and as many item numbers.
MOST_ITEM_SHINGLES = 2_000_000
#: Bits of the filter of the joined search: eight megabytes.
BLOOM_BITS = 26


def needed(n: int, threshold: float) -> int:
    """Shingles of an item of n that a document must hold."""
    return max(1, math.ceil(threshold * n - 1e-9))


def size_class(n: int) -> int:
    """Partition of an item by its shingle count: sizes from 2^c to 2^(c + 1) - 1."""
    return n.bit_length() - 1


def sketch_size(n: int, threshold: float) -> int:
    """k of the bottom-k sketch: that of the largest item of its size partition, all shingles at most."""
    u = (2 << size_class(n)) - 1
    return min(n, u - needed(u, threshold) + 1)


def _lowered(values: list) -> list:
    return [None if v is None else v.lower() for v in values]


def _item_rows(width: int, threshold: float):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in textops.pieces(b, 1)):
            ids = batch.column(0)
            for i, words in textops.doc_words(_lowered(batch.column(1).to_pylist()), textops.MARKS, False):
                if len(words):
                    tokens = textops.shingles(words, width).view(np.int64)
                    k = sketch_size(len(tokens), threshold)
                    low = np.argpartition(tokens, k - 1)[:k]
                    sketched = np.isin(np.arange(len(tokens)), low)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([ids[i].as_py()] * len(tokens), pa.int64()), pa.array([min(width, len(words))] * len(tokens), pa.int32()),
                         pa.array([len(tokens)] * len(tokens), pa.int32()), pa.array([int(np.bitwise_xor.reduce(tokens))] * len(tokens), pa.int64()), pa.array(tokens), pa.array(sketched)],
                        names=["item_id", "width", "n", "set_id", "token", "sketched"],
                    )
    return rows


def item_shingles(benchmark: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """A row per item and shingle: its size, and whether the shingle is in the item's sketch.

    ``set_id`` tells texts of one id apart: the exclusive or of the shingle hashes.
    """
    rows = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text")).distinct()
    return rows.mapInArrow(_item_rows(width, threshold), "item_id long, width int, n int, set_id long, token long, sketched boolean")


class Index:
    """Item sketches and shingles for lookup within a task."""

    def __init__(self, rows: pa.Table, threshold: float):
        """Rows of :func:`item_shingles`."""
        column = lambda name, dtype: rows[name].combine_chunks().fill_null(dtype(0) if dtype is bool else 0).to_numpy(zero_copy_only=False).astype(dtype)
        known = rows["item_id"].combine_chunks().is_valid().to_numpy(zero_copy_only=False)
        keys = [known, *(column(c, np.int64) for c in ("item_id", "width", "n", "set_id"))]
        token, sketched = column("token", np.int64), column("sketched", bool)
        order = np.lexsort((token, *reversed(keys)))
        keys, token, sketched = [k[order] for k in keys], token[order], sketched[order]
        new = np.arange(len(order)) == 0
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        first = np.flatnonzero(new)
        self.ids, self.n, self.tokens, sketch = [], [], [], {}
        for a, b in zip(first, [*first[1:], len(order)][: len(first)], strict=True):
            width, n = int(keys[2][a]), int(keys[3][a])
            for t in token[a:b][sketched[a:b]].tolist():
                sketch.setdefault((width, size_class(n)), []).append((t, len(self.ids)))
            self.ids.append(int(keys[1][a]) if keys[0][a] else None)
            self.n.append(n)
            self.tokens.append(token[a:b])
        self.need = [needed(n, threshold) for n in self.n]
        self.parts = []
        for (width, c), pairs in sorted(sketch.items()):
            pairs.sort()
            self.parts.append((width, needed(1 << c, threshold), np.array([t for t, _ in pairs], np.int64), np.array([i for _, i in pairs])))
        self.widths = sorted({p[0] for p in self.parts})

    def links(self, words: np.ndarray) -> list[tuple[int, int]]:
        """(item number, shared shingles) of the items that a text with these words contains."""
        found = []
        for width in self.widths:
            if len(words) < width:
                continue
            own = textops.shingles(words, width).view(np.int64)
            own.sort()
            hits: set[int] = set()
            for w, least, tokens, item in self.parts:
                if w == width and len(own) >= least:
                    at = np.searchsorted(own, tokens)
                    hits.update(item[own[np.minimum(at, len(own) - 1)] == tokens].tolist())
            for i in hits:
                at = np.searchsorted(own, self.tokens[i])
                shared = int((own[np.minimum(at, len(own) - 1)] == self.tokens[i]).sum())
                if shared >= self.need[i]:
                    found.append((i, shared))
        return found


def _index(items: DataFrame, threshold: float, most: int):
    """The broadcast index, or None if the items exceed the bound."""
    rows = items.limit(most + 1).toArrow()  # one more than the bound: enough to know it is passed
    if rows.num_rows > most:
        return None
    return items.sparkSession.sparkContext.broadcast(Index(rows, threshold))


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    width: int = WIDTH,
    threshold: float = THRESHOLD,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    most_item_shingles: int = MOST_ITEM_SHINGLES,
) -> DataFrame:
    """Links of documents to the test items they contain: doc_id, item_id, item_shingles, shared, containment."""
    items = item_shingles(benchmark, width, threshold, item_id, item_text)
    index = _index(items, threshold, most_item_shingles)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    links = _scan_local(rows, index) if index else _scan_joined(rows, items, threshold)
    links = links.groupBy("doc_id", "item_id").agg(F.max(F.struct(F.col("shared") / F.col("item_shingles"), "item_shingles", "shared")).alias("m"))
    return links.select("doc_id", "item_id", "m.item_shingles", "m.shared", (F.col("m.shared") / F.col("m.item_shingles")).alias("containment"))


def _scan_local(rows: DataFrame, index) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        for batch in (p for b in batches for p in textops.pieces(b, 1)):
            ids, out = batch.column(0), []
            for i, words in textops.doc_words(_lowered(batch.column(1).to_pylist()), textops.MARKS, False):
                out += [(ids[i].as_py(), own.ids[j], own.n[j], shared) for j, shared in own.links(words)]
            if out:
                columns = list(zip(*out, strict=True))
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "item_id", "item_shingles", "shared"])

    return rows.mapInArrow(run, "doc_id long, item_id long, item_shingles int, shared int")


def _spots(tokens: np.ndarray) -> list[np.ndarray]:
    """Two bit numbers of a token in the filter."""
    return [((tokens.view(np.uint64) >> np.uint64(s)) & np.uint64((1 << BLOOM_BITS) - 1)).astype(np.int64) for s in (0, 32)]


def _filter_of(sketch: DataFrame) -> np.ndarray:
    """A Bloom filter, of fixed size whatever the input, of the sketched tokens."""
    spots = [F.pmod(F.shiftrightunsigned("token", s), F.lit(1 << BLOOM_BITS)) for s in (0, 32)]
    words = sketch.select(F.explode(F.array(*spots)).alias("bit")).groupBy(F.shiftright("bit", 6).cast("int").alias("w"))
    got = words.agg(F.bit_or(F.expr("shiftleft(1L, CAST(pmod(bit, 64) AS INT))")).alias("m")).toArrow()  # 2^(BLOOM_BITS - 6) rows at most
    out = np.zeros(1 << (BLOOM_BITS - 6), np.int64)
    out[got["w"].to_numpy()] = got["m"].to_numpy()
    return out.view(np.uint64)


def _scan_joined(rows: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """The same search as joins: sketches find candidates, all shingles of the candidates verify them.

    A filter of fixed size keeps most shingles of documents out of the first shuffle;
    only documents with a hit send all their shingles to the second.
    """
    widths = [r["width"] for r in items.select("width").distinct().collect()]  # WIDTH of them at most
    sketch = items.filter("sketched").select("item_id", "set_id", "width", "n", "token").distinct()
    shared_filter = rows.sparkSession.sparkContext.broadcast(_filter_of(sketch))

    def tokens_of(filtered: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (p for b in batches for p in textops.pieces(b, 2)):
                ids, keys = batch.column(0), batch.column(1)
                for i, words in textops.doc_words(_lowered(batch.column(2).to_pylist()), textops.MARKS, False):
                    for width in widths:
                        if len(words) >= width:
                            tokens = textops.shingles(words, width).view(np.int64)
                            if filtered:
                                a, b = (shared_filter.value[s >> 6] >> (s & 63).astype(np.uint64) & np.uint64(1) for s in _spots(tokens))
                                tokens = tokens[(a & b).astype(bool)]
                            n = len(tokens)
                            yield pa.RecordBatch.from_arrays(
                                [pa.array([ids[i].as_py()] * n, pa.int64()), pa.array([keys[i].as_py()] * n, pa.binary()), pa.array([width] * n, pa.int32()), pa.array(tokens, pa.int64())],
                                names=["doc_id", "text_key", "width", "token"],
                            )

        return run

    schema = "doc_id long, text_key binary, width int, token long"
    keyed = rows.filter(F.col("text").isNotNull()).select("doc_id", F.unhex(F.md5(F.col("text").cast("binary"))).alias("text_key"), "text")
    hits = keyed.mapInArrow(tokens_of(True), schema).join(sketch, ["width", "token"]).select("doc_id", "text_key", "item_id", "set_id", "width", "n").distinct()
    hits = store.written(hits, "hits")
    wanted = hits.join(items.select("set_id", "width", "n", "token").distinct(), ["set_id", "width", "n"]).select("doc_id", "text_key", "item_id", "set_id", "width", "n", "token")
    held = keyed.join(hits.select("text_key").distinct(), "text_key", "left_semi").select("doc_id", "text_key", "text").mapInArrow(tokens_of(False), schema).distinct().withColumnRenamed("doc_id", "_d")
    on = (wanted["text_key"] == held["text_key"]) & wanted["doc_id"].eqNullSafe(held["_d"]) & (wanted["width"] == held["width"]) & (wanted["token"] == held["token"])
    shared = wanted.join(held, on, "left_semi").groupBy("doc_id", "text_key", "item_id", "set_id", "n").agg(F.count(F.lit(1)).cast("int").alias("shared"))
    enough = F.col("shared") >= F.greatest(F.lit(1), F.ceil(threshold * F.col("n") - 1e-9))
    return shared.filter(enough).select("doc_id", "text_key", "item_id", F.col("n").alias("item_shingles"), "shared")


def remove_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    width: int = WIDTH,
    threshold: float = THRESHOLD,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    most_item_shingles: int = MOST_ITEM_SHINGLES,
) -> DataFrame:
    """The rows of ``docs`` that contain no test item, with all their columns."""
    items = item_shingles(benchmark, width, threshold, item_id, item_text)
    index = _index(items, threshold, most_item_shingles)
    at = docs.columns.index(text)
    if index:

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = index.value
            for batch in (p for b in batches for p in textops.pieces(b, at)):
                clean = np.ones(batch.num_rows, bool)
                for i, words in textops.doc_words(_lowered(batch.column(at).to_pylist()), textops.MARKS, False):
                    clean[i] = not own.links(words)
                yield batch.filter(pa.array(clean))

        return docs.mapInArrow(keep, docs.schema)
    key = F.unhex(F.md5(F.col(f"`{text}`").cast("binary")))
    by_text = docs.select(F.hash(F.col(f"`{text}`")).cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).distinct()
    dirty = _scan_joined(by_text, items, threshold).select("text_key").distinct()
    return docs.join(dirty, key.eqNullSafe(dirty["text_key"]), "left_anti")


def oracle(width: int = WIDTH, threshold: float = THRESHOLD) -> str:
    """The links of ``documents`` and ``benchmark`` in DuckDB SQL, by a join of all shingles."""
    words = "regexp_extract_all(lower(text), '[a-z0-9\\x{80}-\\x{10FFFF}]+')"
    cut = lambda m: f"list_transform(range(1, len(w) - {m} + 2), lambda i: array_to_string(w[i:i + {m} - 1], ' '))"
    return f"""
WITH q AS (SELECT item_id, w, least(len(w), {width}) AS m FROM (SELECT DISTINCT item_id, {words} AS w FROM benchmark) WHERE len(w) > 0),
i AS (SELECT DISTINCT item_id, m, unnest({cut("m")}) AS g FROM q), s AS (SELECT item_id, count(*) AS n FROM i GROUP BY 1),
d AS (SELECT doc_id, {words} AS w FROM documents), k AS (SELECT DISTINCT m FROM q),
t AS (SELECT DISTINCT doc_id, m, unnest({cut("m")}) AS g FROM d, k WHERE len(w) >= m)
SELECT doc_id, item_id, any_value(n)::INTEGER AS item_shingles, count(*)::INTEGER AS shared, count(*) / any_value(n) AS containment
FROM t JOIN i USING (m, g) JOIN s USING (item_id) GROUP BY doc_id, item_id HAVING count(*) >= greatest(1, ceil({threshold} * any_value(n) - 1e-9))
""".strip()
