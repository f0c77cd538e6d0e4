"""Operator 2: n-gram Jaccard join by signature trees.

Texts are sets of hashed word shingles. Equal sets are one class from the start,
so exact copies cost one row each. Two classes link when their Jaccard
similarity reaches the threshold t; the join is exact up to 64-bit hashes.

Blocks. Shingles are put in one global order, rare ones first; a set of n then
links with another only if they share one of its first n - ceil(t n) + 1
shingles. Rarity comes from a counting sketch of fixed size over all texts; it only
chooses the order, and any order is exact. So passages that a large part of all
texts share are last and make no blocks. Shingles with one least holder make one
block, so a group of near copies is in few of them. A shingle that the sketch
shows to be rare enough (its holders are fewer than one in HOT_SHARE of all
shingles, so less than a task's share) finds its holders in one shuffle; the
few others are counted by partial sums, and their counts sent to the holders.

Signature trees. The classes of a block form a tree for each bitmap width (four
bits a shingle): a leaf holds a class's token bitmap and size, a node the OR and
the AND of its children's bitmaps, and their size range. Two trees, or a tree and
itself, are walked together from the root: a pair of nodes is dropped when its
sizes are too far apart, when the largest overlap that the bitmaps leave open is
under the overlap that its sizes ask for, or when all its classes are connected
already. Pairs of leaves that remain are candidates.

Two walks. The first, on bitmaps, only tells which classes of a block have a
candidate at all. The second goes with the whole shingle sets of those, verifies
each candidate where it is met and returns a forest: a link only if it connects
two classes that earlier ones do not. Both return fewer rows than they take, so a
group of thousands of near copies is never expanded into all its pairs. Blocks
beyond a bound of rows or shingles are cut into chunks (see :func:`_walked`).

Defined results: null or wordless texts have no shingles and link with nothing;
their component is their own doc_id. Rows of one doc_id and different texts
count each for themselves; a null doc_id gets the component of its class's
smallest id, null if there is none. Repeated rows give repeated results. No rows
give no rows. Extra columns pass through ``deduplicate``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm import store, textops
from shelfmark.llm.components import components

WIDTH, THRESHOLD = 4, 0.85
SKETCH_BITS, SLICES, SALTS = 19, 32, 512
WORDS, MOST_WORDS = 16, 1_024  # 64-bit words of a bitmap: 1,024 to 65,536 bits
#: Bitmap words that a step of a walk compares, and shingles that a step verifies.
FANOUT, FRONTIER_WORDS, RUN_TOKENS = 8, 1 << 18, 1 << 18
#: Bounds of a block that one task walks: classes, and shingles in all of them.
BLOCK_ROWS, BLOCK_TOKENS = 2_000, 1 << 21
#: A shingle with more than one in so many of all shingles is counted apart.
HOT_SHARE = 8_192
#: Rows of small blocks that a task takes together.
GROUP_ROWS = 4_000
BLOOM_BITS = 25


def least_overlap(n: int, threshold: float) -> int:
    """Shared shingles that a set of n needs at least, with any other."""
    return max(1, math.ceil(threshold * n - 1e-9))


def probe_length(n: int, threshold: float) -> int:
    """First shingles of the global order of which a link shares one."""
    return n - least_overlap(n, threshold) + 1


def text_key(text: Column) -> Column:
    """128-bit key of a text."""
    return F.unhex(F.md5(text.cast("binary")))


def class_key(tokens: np.ndarray) -> bytes:
    """128-bit key of a sorted shingle set."""
    return xxhash.xxh3_128_digest(tokens.tobytes())


def wide_bitmap(tokens: np.ndarray) -> np.ndarray:
    """Token bitmap of the set's own width: four bits a shingle, from WORDS to MOST_WORDS words.

    Bits are hashes modulo a power of two, so a wider bitmap folds to a narrower
    one by OR.
    """
    width = 1 << int(min(max(4 * len(tokens) - 1, WORDS * 64 - 1), MOST_WORDS * 64 - 1)).bit_length()
    bits = np.zeros(width, bool)
    bits[(textops.mix(tokens) & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").view(np.uint64)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """A bitmap folded to so many words."""
    return np.bitwise_or.reduce(bits.reshape(-1, words), axis=0)


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """Token bitmap of the least width."""
    return folded(wide_bitmap(tokens), WORDS)


def _sketch(docs: DataFrame, width: int) -> np.ndarray:
    """Counts of shingles by hash bucket over all texts: a vector of fixed size."""
    size, part = 1 << SKETCH_BITS, (1 << SKETCH_BITS) // SLICES

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for batch in (p for b in batches for p in textops.pieces(b, 0)):
            held, n = [], 0
            for _, words in textops.doc_words(batch.column(0).to_pylist()):
                tokens = textops.shingles(words, width, distinct=False)  # repeats only shift the order
                held.append(tokens)
                n += len(tokens)
                if n > RUN_TOKENS:
                    counts += np.bincount((np.concatenate(held) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=size)
                    held, n = [], 0
            if held:
                counts += np.bincount((np.concatenate(held) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=size)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(SLICES), pa.int32()), pa.array([counts[i * part : (i + 1) * part].astype(np.int32).tobytes() for i in range(SLICES)], pa.binary())], names=["slice", "counts"]
        )

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(part, np.int64)
        for r in rows["counts"]:
            out += np.frombuffer(r, np.int32)
        return pd.DataFrame({"slice": [rows["slice"].iloc[0]], "counts": [np.minimum(out, 2**31 - 1).astype(np.int32).tobytes()]})

    parts = docs.select("text").mapInArrow(tally, "slice int, counts binary").withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    # Added in two levels, so that no group grows with the number of tasks beyond its share.
    parts = parts.groupBy("slice", "salt").applyInPandas(add, "slice int, counts binary").groupBy("slice").applyInPandas(add, "slice int, counts binary")
    out = np.zeros((SLICES, part), np.int32)
    for r in parts.collect():  # SLICES rows, two megabytes in all
        out[r["slice"]] = np.frombuffer(r["counts"], np.int32)
    return out.ravel()


def _profiles(docs: DataFrame, width: int, threshold: float, sketch) -> DataFrame:
    """Per row: doc_id, text key, class key, set size, the prefix of its set in the global order (common shingles apart), token bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = sketch.value
        bound = weight.sum(dtype=np.int64) // HOT_SHARE
        for batch in (p for b in batches for p in textops.pieces(b, 1)):
            keys, sizes, prefixes, hot, wide = [], [], [], [], []
            for _, tokens in textops.doc_shingles(batch.column(1).to_pylist(), width):
                n = len(tokens)
                sizes.append(n)
                if not n:
                    keys.append(None)
                    prefixes.append([])
                    hot.append([])
                    wide.append(None)
                    continue
                keys.append(class_key(tokens))
                heavy = weight[(tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                order = np.argsort(heavy, kind="stable")[: probe_length(n, threshold)]  # ties by hash
                many = heavy[order] > bound
                prefixes.append(tokens[order[~many]].view(np.int64))
                hot.append(tokens[order[many]].view(np.int64))
                wide.append(wide_bitmap(tokens).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), *(pa.array(p, pa.list_(pa.int64())) for p in (prefixes, hot)), pa.array(wide, pa.binary())],
                names=["doc_id", "text_key", "key", "n", "prefix", "hot", "wide"],
            )

    rows = docs.select("doc_id", "text", text_key(F.col("text")).alias("text_key"))
    return rows.mapInArrow(run, "doc_id long, text_key binary, key binary, n long, prefix array<long>, hot array<long>, wide binary")


def _row_hash() -> Column:
    return F.xxhash64("text_key", "doc_id")


def _sets(docs: DataFrame, width: int, wanted: DataFrame) -> DataFrame:
    """(key, tokens) of the wanted classes (key, doc_id, text_key), read from the one text that stands for each.

    A Bloom filter of fixed size spares the other texts the work and the way
    through the shuffle; the exact semi-join decides.
    """
    spots = [F.pmod(F.shiftright(_row_hash(), s), F.lit(1 << BLOOM_BITS)) for s in (0, 21)]
    words = wanted.select(F.explode(F.array(*spots)).alias("bit")).groupBy(F.shiftright("bit", 5).cast("int").alias("w"))
    got = words.agg(F.bit_or(F.expr("shiftleft(1L, CAST(pmod(bit, 32) AS INT))")).alias("m")).toArrow()  # at most 2^20 rows, whatever the input
    bloom = np.zeros(1 << (BLOOM_BITS - 5), np.int64)
    bloom[got["w"].to_numpy()] = got["m"].to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(bloom)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = shared.value
        for batch in batches:
            h = batch.column(1).to_numpy()
            hit = np.ones(len(h), bool)
            for s in (0, 21):
                bit = (h >> s) & ((1 << BLOOM_BITS) - 1)
                hit &= (filled[bit >> 5] >> (bit & 31) & 1).astype(bool)
            for piece in textops.pieces(batch.filter(pa.array(hit)), 0):
                found = [t for _, t in textops.doc_shingles(piece.column(0).to_pylist(), width) if len(t)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([class_key(t) for t in found], pa.binary()), pa.array([t.tobytes() for t in found], pa.binary())], names=["key", "tokens"])

    rows = docs.select("doc_id", "text", text_key(F.col("text")).alias("text_key")).select("text", _row_hash().alias("h"))
    return rows.mapInArrow(run, "key binary, tokens binary").join(wanted.select("key"), "key", "left_semi").dropDuplicates(["key"])


def _flat(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    starts = np.concatenate(([0], np.cumsum([len(p) for p in parts])[:-1]))
    return np.concatenate(parts), starts


def similar(own: np.ndarray, others: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which of the other sets reach the threshold with this one; sets are sorted and hold something."""
    out = []
    first = size = 0
    for i, other in enumerate(others):
        size += len(other)
        if size < RUN_TOKENS and i + 1 < len(others):
            continue
        tokens, starts = _flat(others[first : i + 1])
        at = np.searchsorted(own, tokens)
        at[at == len(own)] = 0
        shared = np.add.reduceat((own[at] == tokens).astype(np.int64), starts)
        n = np.array([len(o) for o in others[first : i + 1]])
        out.append(shared >= threshold * (len(own) + n - shared) - 1e-9)
        first, size = i + 1, 0
    return np.concatenate(out) if out else np.zeros(0, bool)


def possible(n: int, wide: np.ndarray, m: np.ndarray, others: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which of the other sets can reach the threshold with this one, by sizes and bitmaps."""
    keep = np.minimum(n, m) >= threshold * np.maximum(n, m) - 1e-9
    for i in np.flatnonzero(keep):
        words = min(len(wide), len(others[i]))
        a, b = folded(wide, words), folded(others[i], words)
        most = min(n - int(np.bitwise_count(a & ~b).sum()), m[i] - int(np.bitwise_count(b & ~a).sum()))
        keep[i] = most >= threshold / (1 + threshold) * (n + m[i]) - 1e-9
    return keep


class Tree:
    """A signature tree over classes, level by level from the leaves."""

    def __init__(self, bits: np.ndarray, n: np.ndarray, component: np.ndarray):
        """Classes are expected in the order in which they are to be leaves."""
        self.levels = [(bits, bits, n, n, component)]
        while len(self.levels[-1][2]) > 1:
            union, common, low, high, comp = self.levels[-1]
            at = np.arange(0, len(low), FANOUT)
            first, last = np.minimum.reduceat(comp, at), np.maximum.reduceat(comp, at)
            self.levels.append((
                np.bitwise_or.reduceat(union, at, axis=0), np.bitwise_and.reduceat(common, at, axis=0),
                np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.where((first == last) & (first >= 0), first, -1),
            ))


def pairs_of(a: Tree, b: Tree | None, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Leaf pairs that bitmaps, sizes and components leave open; of one tree if b is None."""
    own, b = b is None, b or a
    ratio = threshold / (1 + threshold)
    step = max(1, FRONTIER_WORDS // a.levels[0][0].shape[1] // (FANOUT * FANOUT))
    depth = max(len(a.levels), len(b.levels)) - 1
    stack = [(depth, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        level, i, j = stack.pop()
        la, lb = min(level, len(a.levels) - 1), min(level, len(b.levels) - 1)
        (ua, ca, lowa, higha, compa), (ub, cb, lowb, highb, compb) = a.levels[la], b.levels[lb]
        keep = (higha[i] >= threshold * lowb[j] - 1e-9) & (highb[j] >= threshold * lowa[i] - 1e-9)
        keep &= (compa[i] < 0) | (compa[i] != compb[j])
        i, j = i[keep], j[keep]
        # Shingles that every class of one node has and none of the other can share.
        missing_a = np.bitwise_count(ca[i] & ~ub[j]).sum(1, dtype=np.int64)
        missing_b = np.bitwise_count(cb[j] & ~ua[i]).sum(1, dtype=np.int64)
        most = np.minimum(higha[i] - missing_a, highb[j] - missing_b)
        keep = most >= ratio * (lowa[i] + lowb[j]) - 1e-9
        i, j = i[keep], j[keep]
        if level == 0:
            if own:
                i, j = i[i < j], j[i < j]
            if len(i):
                yield i, j
            continue
        na, nb = len(a.levels[min(level - 1, len(a.levels) - 1)][2]), len(b.levels[min(level - 1, len(b.levels) - 1)][2])
        fa, fb = (FANOUT if la == level else 1), (FANOUT if lb == level else 1)
        for s in range(0, len(i), step):
            x, y = i[s : s + step], j[s : s + step]
            xi = (x[:, None, None] * fa + np.arange(fa)[None, :, None] + np.zeros((1, 1, fb), np.int64)).ravel()
            yj = (y[:, None, None] * fb + np.arange(fb)[None, None, :] + np.zeros((1, fa, 1), np.int64)).ravel()
            fits = (xi < na) & (yj < nb)
            if own:
                fits &= xi <= yj
            stack.append((level - 1, xi[fits], yj[fits]))


def open_pairs(left: np.ndarray, right: np.ndarray | None, n: np.ndarray, wide: list[np.ndarray], code: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs of ``left`` with ``right`` (or of ``left`` with itself) that a walk over signature trees leaves open.

    Sets whose bitmaps have one width make one tree; trees of two widths meet at
    the narrower one. Rows of one code never pair.
    """
    width = np.array([len(w) for w in wide])

    def trees(rows: np.ndarray) -> dict[int, np.ndarray]:
        return {int(w): (at := rows[width[rows] == w])[np.lexsort((n[at], code[at]))] for w in np.unique(width[rows])}

    def tree(rows: np.ndarray, words: int) -> Tree:
        return Tree(np.stack([folded(wide[r], words) for r in rows]), n[rows], code[rows])

    a, b = trees(left), None if right is None else trees(right)
    for w, x in a.items():
        for v, y in (a if b is None else b).items():
            if b is None and v < w or n[x].max() < threshold * n[y].min() - 1e-9 or n[y].max() < threshold * n[x].min() - 1e-9:
                continue
            words, same = min(w, v), b is None and v == w
            for i, j in pairs_of(tree(x, words), None if same else tree(y, words), threshold):
                yield x[i], y[j]


def may_link(left: np.ndarray, right: np.ndarray | None, n: np.ndarray, wide: list[np.ndarray], code: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows have a partner that bitmaps leave open; rows of code 0 are known to have one."""
    out = code == 0
    for i, j in open_pairs(left, right, n, wide, code, threshold):
        out[i] = out[j] = True
    return out


def forest(left: np.ndarray, right: np.ndarray | None, n: np.ndarray, tokens: list[np.ndarray], code: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Verified links that connect all rows which links connect; codes tell what is connected already."""
    parent = {int(c): int(c) for c in code}

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = c = parent[parent[c]]
        return c

    links = []
    for i, j in open_pairs(left, right, n, [wide_bitmap(t) for t in tokens], code, threshold):
        order = np.lexsort((j, i))
        i, j = i[order], j[order]
        for at in np.split(np.arange(len(i)), np.flatnonzero(np.diff(i)) + 1):
            x = int(i[at[0]])
            own = root(int(code[x]))
            to = [int(y) for y in j[at] if root(int(code[y])) != own]
            good = similar(tokens[x], [tokens[y] for y in to], threshold)
            for y, g in zip(to, good, strict=True):
                p, q = root(int(code[x])), root(int(code[y]))
                if g and p != q:
                    parent[max(p, q)] = min(p, q)
                    links.append((x, y))
    return links


def _loads(column: pd.Series) -> list[np.ndarray]:
    return [np.frombuffer(b, np.uint64) for b in column]


def _codes(keys: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """0 for rows that the block's centre connects, else a number of the class."""
    return np.where(linked, 0, pd.factorize(keys)[0] + 1)


def _starred(n: np.ndarray, loads: list[np.ndarray], centre: int, exact: bool, threshold: float) -> np.ndarray:
    """Which rows link with the centre (exact), or may."""
    if exact:
        fits = np.minimum(n, n[centre]) >= threshold * np.maximum(n, n[centre]) - 1e-9
        fits[fits] = similar(loads[centre], [loads[i] for i in np.flatnonzero(fits)], threshold)
        return fits
    return possible(int(n[centre]), loads[centre], n, loads, threshold)


def _result(rows: pd.DataFrame, found, exact: bool) -> pd.DataFrame:
    if exact:
        keys = rows["key"].to_numpy()
        return pd.DataFrame({"src": pd.Series([min(keys[i], keys[j]) for i, j in found], dtype=object), "dst": pd.Series([max(keys[i], keys[j]) for i, j in found], dtype=object)})
    return rows[["block", "h", "n"]][found]


RESULT = {True: "src binary, dst binary", False: "block long, h long, n long"}


def _small_blocks(threshold: float, exact: bool):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block", kind="stable").reset_index(drop=True)
        keys, n, loads, block, hashes = rows["key"].to_numpy(), rows["n"].to_numpy(), _loads(rows["load"]), rows["block"].to_numpy(), rows["h"].to_numpy()
        found = [] if exact else np.zeros(len(rows), bool)
        for at in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(block)) + 1):
            own, m = [loads[i] for i in at], n[at]
            centre = int(hashes[at].argmin())
            star = _starred(m, own, centre, exact, threshold)
            linked = star & (star.sum() > 1)
            code, rest = _codes(keys[at], linked), np.arange(len(at))
            if exact:
                found += [(int(at[centre]), int(at[i])) for i in np.flatnonzero(star) if i != centre]
                found += [(int(at[i]), int(at[j])) for i, j in forest(rest, None, m, own, code, threshold)]
            else:
                found[at] = may_link(rest, None, m, own, code, threshold)
        return _result(rows, found, exact)

    return run


def _chunk_pairs(threshold: float, exact: bool):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        keys, n, loads, linked = rows["key"].to_numpy(), rows["n"].to_numpy(), _loads(rows["load"]), rows["linked"].to_numpy()
        code, side = _codes(keys, linked), rows["side"].to_numpy()
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(left) or not len(right):
            return _result(rows, [] if exact else np.zeros(len(rows), bool), exact)
        found = (forest if exact else may_link)(left, right, n, loads, code, threshold)
        return _result(rows, found if exact else found & ~linked, exact)

    return run


def _star_of_large(threshold: float, exact: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = batch.column(2).to_numpy(), batch.column(5).to_numpy()
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                a, b = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint64) for c in (3, 6))
                keep[i] = _starred(np.array([m[i], n[i]]), [b, a], 0, exact, threshold)[1]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (0, 1, 2, 4, 7)), pa.array(keep)], names=["block", "key", "n", "centre", "h", "linked"])

    return run


def _walked(
    blocks: DataFrame, loads: DataFrame, exact: bool, threshold: float, block_rows: int, block_tokens: int, scratch: store.Scratch
) -> DataFrame:
    """A walk over the trees of all ``blocks`` (block, h, n), of bitmaps or, if ``exact``, of whole shingle sets; ``loads`` are (h, key, load).

    Bitmaps leave the rows (block, h, n) that may link; whole sets give verified
    links (src, dst), fewer than rows. h is a hash of the class key: classes that
    share one go the same ways, each for itself. A block's centre, its least hash, is
    compared with all its rows first: what it connects is one component to the
    trees. Blocks over a bound of rows or shingles are cut: every chunk of the rows
    that the centre doesn't connect meets every chunk of the block, each pair in a task.
    """
    sizes = scratch.written(blocks.groupBy("block").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("total")), "sizes")
    large = (F.col("size") > block_rows) | (F.col("total") > block_tokens)
    share, hot = sizes.agg(F.greatest(F.sum("size") / GROUP_ROWS, F.sum("total") / block_tokens), F.count_if(large)).first()
    groups = max(1, math.ceil(share or 0))
    small = blocks
    if hot:
        chunks = F.ceil(F.greatest(F.col("size") / block_rows, F.col("total") / block_tokens)).cast("int")
        hot_sizes = scratch.written(sizes.filter(large).select("block", chunks.alias("chunks")), "large")
        small = blocks.join(hot_sizes, "block", "left_anti")
    grouped = small.join(loads, "h").select(F.pmod(F.xxhash64("block"), F.lit(groups)).alias("group"), "block", "key", "n", "load", "h")
    out = grouped.groupBy("group").applyInPandas(_small_blocks(threshold, exact), RESULT[exact])
    if not hot:
        return out

    rows = scratch.written(blocks.join(hot_sizes, "block"), "rows")
    first = rows.groupBy("block").agg(F.min(F.struct("h", "n")).alias("c")).select("block", F.col("c.h").alias("h"), F.col("c.n").alias("m"))
    first = first.join(loads, "h").select("block", "m", F.col("key").alias("centre"), F.col("load").alias("centre_load")).dropDuplicates(["block"])
    first = scratch.written(first, "centres")
    star = rows.join(loads, "h").join(first, "block").select("block", "key", "n", "load", "centre", "m", "centre_load", "h")
    star = scratch.written(star.mapInArrow(_star_of_large(threshold, exact), "block long, key binary, n long, centre binary, h long, linked boolean"), "stars")
    rest = star.filter("NOT linked").groupBy("block").agg(F.count(F.lit(1)).alias("r"), F.sum("n").alias("rn"))
    cuts = F.ceil(F.greatest(F.col("r") / block_rows, F.col("rn") / block_tokens)).cast("int").alias("cuts")
    counted = star.join(scratch.written(rest.join(hot_sizes, "block").select("block", "chunks", cuts), "rest"), "block")
    i, j = F.pmod(F.xxhash64("key", F.lit(1)), F.col("cuts")).cast("int"), F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int")
    columns = ["block", "h", "key", "n", "linked"]
    left = counted.filter("NOT linked").select(*columns, i.alias("i"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("j"), F.lit(0).alias("side"))
    right = counted.select(*columns, F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("i"), j.alias("j"), F.lit(1).alias("side"))
    pairs = left.unionByName(right).join(loads, ["h", "key"]).groupBy("block", "i", "j").applyInPandas(_chunk_pairs(threshold, exact), RESULT[exact])
    if exact:
        met = star.filter(F.col("linked") & (F.col("key") != F.col("centre")))
        return out.union(pairs).union(met.select(F.least("centre", "key").alias("src"), F.greatest("centre", "key").alias("dst")))
    return out.union(pairs.distinct()).union(star.filter("linked").select("block", "h", "n"))


def _blocks(classes: DataFrame, threshold: float) -> DataFrame:
    """(block, h, n): classes that share a shingle of their prefixes, under the least class hash h among its holders.

    Blocks of shingles with the same least holder are one: it is near to all
    their members.
    """
    met = (F.count(F.lit(1)), F.min("n"), F.max("n"), F.min("h"))
    names = ("size", "lo", "hi", "block")
    holders = Window.partitionBy("token")
    rare = classes.select(F.explode("prefix").alias("token"), "h", "n").select("h", "n", *[c.over(holders).alias(name) for c, name in zip(met, names, strict=True)])
    posts = classes.select(F.explode("hot").alias("token"), "h", "n")
    counts = posts.groupBy("token").agg(*[c.alias(name) for c, name in zip(met, names, strict=True)])
    common = posts.join(counts, "token").select("h", "n", *names)
    fits = (F.col("size") > 2) | (F.col("size") == 2) & (F.col("lo") >= threshold * F.col("hi") - 1e-9)
    return rare.union(common).filter(fits).select("block", "h", "n").distinct()


def join(
    docs: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, block_rows: int = BLOCK_ROWS, block_tokens: int = BLOCK_TOKENS
) -> tuple[DataFrame, DataFrame]:
    """Classes of all rows and the links found between them.

    Returns (profiles, links): profiles has doc_id, text_key, key and n per row of ``docs``
    (doc_id, text); links has verified pairs (src, dst) of class keys that
    connect all classes which links of the full join connect.
    """
    spark = docs.sparkSession
    sketch = spark.sparkContext.broadcast(_sketch(docs, width))
    full = store.written(_profiles(docs, width, threshold, sketch), "full")
    profiles = store.written(full.select("doc_id", "text_key", "key", "n"), "profiles")
    by_class = full.filter("n > 0").groupBy("key").agg(F.first(F.struct("n", "prefix", "hot", "wide")).alias("p"), F.min(F.struct("doc_id", "text_key")).alias("rep"))
    classes = store.written(by_class.select("key", F.xxhash64("key").alias("h"), "p.*", "rep"), "classes")
    store.drop(full)
    blocks = store.written(_blocks(classes, threshold), "blocks")
    bitmaps = classes.select("h", "key", F.col("wide").alias("load"))
    scratch = store.Scratch()
    left_open = store.written(_walked(blocks, bitmaps, False, threshold, block_rows, block_tokens, scratch), "open")
    store.drop(blocks)
    wanted = store.written(classes.select("h", "key", "rep.doc_id", "rep.text_key").join(left_open.select("h").distinct(), "h", "left_semi").drop("h"), "wanted")
    sets = store.written(_sets(docs, width, wanted).select(F.xxhash64("key").alias("h"), "key", F.col("tokens").alias("load")), "sets")
    links = store.written(_walked(left_open, sets, True, threshold, block_rows, block_tokens, scratch), "links")
    scratch.clear(classes, left_open, wanted, sets)
    return profiles, links


def classify(docs: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of every row of ``docs`` (doc_id, text).

    n_links counts the row's links that were found and kept: enough to connect
    its component, not all pairs of it.
    """
    small, named = _named(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), width, threshold, block_rows)
    return small.join(named, "key", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def _named(docs: DataFrame, width: int, threshold: float, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, text_key, key, n) and classes (key, component, component_id, n_links)."""
    profiles, links = join(docs, width, threshold, block_rows)
    labels = components(links)
    degree = links.select(F.explode(F.array("src", "dst")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n_links"))
    small = profiles.select("doc_id", "text_key", "key", "n")
    classes = small.filter("n > 0").groupBy("key").agg(F.min("doc_id").alias("first_id"))
    classes = classes.join(labels.withColumnRenamed("id", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    ids = classes.groupBy("component").agg(F.min("first_id").alias("component_id"))
    return small, store.written(classes.join(ids, "component").join(degree, "key", "left").select("key", "component", "component_id", "n_links"), "classes")


def deduplicate(docs: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row of each component of ``docs`` (doc_id, text and others), with all its columns.

    It is a row of the smallest doc_id (null ids last), of that the least text
    key, of repeated rows any one. Rows without shingles all stay.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    small, named = _named(slim, width, threshold, block_rows)
    pick = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("m")
    kept = small.filter("n > 0").join(named.select("key", "component"), "key").groupBy("component").agg(pick)
    kept = store.written(kept.select(F.coalesce("m.doc_id", F.lit(0)).alias("_id"), F.col("m.none").alias("_none"), F.col("m.text_key").alias("_key")), "kept")
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    id_ = F.col("doc_id").cast("long")
    rows = docs.filter(worded).select(
        F.coalesce(id_, F.lit(0)).alias("_id"), id_.isNull().alias("_none"), text_key(F.col("text")).alias("_key"), F.struct(*docs.columns).alias("_row")
    )
    # Repeated rows meet in a partial aggregate before they are dealt out.
    one = rows.join(kept, ["_id", "_none", "_key"], "left_semi").groupBy("_id", "_none", "_key").agg(F.first("_row").alias("_row"))
    return one.select("_row.*").unionByName(docs.filter(~worded))


def oracle(width: int = WIDTH, percent: int = 85) -> str:
    """doc_id, n_shingles and component_id over ``documents`` in DuckDB SQL: every pair that shares a shingle is compared."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(text, '{upper}', '{lower}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(2, len(w) - {width - 2})), lambda i: array_to_string(w[i:i + {width - 1}], ' '))) AS g FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= {percent} * (x.n + y.n - shared)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, e.b FROM reach JOIN e ON e.a = reach.other)
SELECT r.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.other) AS component_id FROM reach r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
""".strip()
