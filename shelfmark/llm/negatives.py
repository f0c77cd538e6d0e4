"""Operator 11: hard negatives by a Voronoi-partitioned distributed kNN join.

A score is the inner product of whole-number vectors. Every row becomes a point
of a space with one dimension more, (x, sqrt(M^2 - |x|^2)) with M the largest
length, and an anchor becomes (q, 0): there the distance between an anchor and a row
falls as their score rises. Rows belong to the cell of their nearest pivot.

Anchors of a cell (and, for positives, of a label) form groups of about ``group``.
An anchor is first searched in its own cell, which bounds the distance that
whatever is still missing may have. From its distance to every pivot and that
bound follows, for each group and cell, a ring of distances to the cell's pivot
outside which no row can serve the group (triangle inequality), or that the whole
cell can't (the plane between two pivots). Rows go to the groups whose rings they
lie in, and there an exact join keeps what the anchors need.

Positives: the first ``positives`` other rows of the anchor's label. Negatives: for
each positive the first ``negatives`` rows of other labels with
positive <= 2 * negative and 20 * negative <= 19 * positive. Ties go to the smaller
vec_id. A group's rows are dealt to blocks of about ``block`` rows, so a cell that
holds a third of all rows is many tasks; a block returns at most what its anchors
keep.

Defined results: rows with a null id, label or vector, or a null or non-finite
component take no part; shorter vectors count as filled up with zeros. Of an
anchor id that is repeated the row with the smallest (label, vector) is the anchor.
Rows of one vec_id count once for an anchor (the largest score that serves) and
never for the anchor of that id. Positives that score under 0 have no negatives. No
anchors, or no rows, give no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm import integers, store

POSITIVES, NEGATIVES = 5, 3
GROUP, BLOCK = 1_024, 8_192
LEAST_PIVOTS, MOST_PIVOTS = 4, 512
#: Width added to rings: distances are doubles, scores are exact.
SLACK = 1e-6
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


@dataclass
class Cells:
    """Pivots in the augmented space (the last component is the added one) and the largest squared length."""

    pivots: np.ndarray
    most: float

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """Distance of each row, lifted, to each pivot."""
        return self._apart(np.concatenate((x, np.sqrt(np.maximum(0, self.most - (x * x).sum(1)))[:, None]), 1))

    def asked(self, q: np.ndarray) -> np.ndarray:
        """Distance of each anchor to each pivot."""
        return self._apart(np.concatenate((q, np.zeros((len(q), 1))), 1))

    def _apart(self, x: np.ndarray) -> np.ndarray:
        p = self.pivots
        return np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (p * p).sum(1)[None] - 2 * (x @ p.T)))

    def between(self) -> np.ndarray:
        """Distance of each pivot to each pivot."""
        return self._apart(self.pivots)

    def away(self, q: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Distance at which a row has that score for the anchor; a score out of reach is distance 0."""
        return np.sqrt(np.maximum(0, (q * q).sum(1) + self.most - 2 * score))


def pivots(rows: DataFrame, anchors: int, dims: int, most: float) -> Cells:
    """Cells around vectors chosen by hash: a quarter of the square root of the number of anchors."""
    count = int(np.clip(np.ceil(np.sqrt(anchors) / 4), LEAST_PIVOTS, MOST_PIVOTS))
    picked = rows.select("v", F.xxhash64("vec_id", F.lit(11)).alias("h")).orderBy("h", "v").limit(4 * count).collect()  # 4 * MOST_PIVOTS rows
    x = np.array([r["v"] for r in picked], float).reshape(len(picked), dims)
    x = x[np.sort(np.unique(x, axis=0, return_index=True)[1])][:count]
    return Cells(np.concatenate((x, np.sqrt(np.maximum(0, most - (x * x).sum(1)))[:, None]), 1), most)


def _homed(rows: DataFrame, cells: Cells, dims: int, anchors: bool) -> DataFrame:
    """``rows`` with their cell and distance to its pivot."""
    shared = rows.sparkSession.sparkContext.broadcast(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = integers.matrix(b["v"], dims)
            apart = shared.value.asked(x) if anchors else shared.value.lifted(x)
            cell = apart.argmin(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(apart[np.arange(len(x)), cell])], names=[*b.schema.names, "cell", "apart"])

    return rows.mapInArrow(run, "vec_id long, label string, v array<int>, cell int, apart double")


def rings(cells: Cells, q: np.ndarray, home: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each cell the ring of distances to its pivot that may hold a row some anchor scores from ``least`` to ``most``.

    Cells that can't serve any anchor, and every anchor's home cell, have an empty ring (inf, -inf).
    """
    to, far, near = cells.asked(q), cells.away(q, least), cells.away(q, most)
    far = np.where(np.isneginf(least), np.inf, far) * (1 + SLACK) + SLACK
    near = np.where(np.isposinf(most), 0, near) * (1 - SLACK) - SLACK
    own = to[np.arange(len(q)), home]
    with np.errstate(divide="ignore", invalid="ignore"):
        plane = (to**2 - (own**2)[:, None]) / (2 * cells.between()[home])
    out = np.nan_to_num(plane, nan=0.0, posinf=0.0, neginf=0.0) > far[:, None]
    low = np.where(out, np.inf, np.maximum(to - far[:, None], near[:, None] - to))
    high = np.where(out, -np.inf, to + far[:, None])
    rows = np.arange(len(q))
    low[rows, home], high[rows, home] = np.inf, -np.inf
    return low.min(0), high.max(0)


def _grouped(anchors: DataFrame, by: list[str], group: int) -> DataFrame:
    """``anchors`` with a group number ``gid``: of one value of ``by`` each, of ``group`` anchors on average at most."""
    sizes = anchors.groupBy(*by).agg(F.ceil(F.count("*") / group).cast("int").alias("chunks"))
    chunk = F.pmod(F.xxhash64("vec_id", F.lit(5)), F.col("chunks"))
    return anchors.join(sizes, by).select("vec_id", "label", "v", "cell", *[c for c in anchors.columns if c not in ("vec_id", "label", "v", "cell", "apart")], F.struct(*by, chunk.alias("chunk")).alias("gid"))


def _reach(grouped: DataFrame, cells: Cells, dims: int) -> DataFrame:
    """(gid, label, cell, low, high): the cells beside its own that may serve a group, from its anchors' ``least`` and ``most``."""
    shared = grouped.sparkSession.sparkContext.broadcast(cells)
    gid = grouped.schema["gid"].dataType.simpleString()

    def run(key: tuple, table: pa.Table) -> pa.Table:
        q = integers.matrix(table["v"], dims)
        low, high = rings(shared.value, q, table["cell"].to_numpy(), table["least"].to_numpy(), table["most"].to_numpy())
        at = np.flatnonzero(low <= high)
        gids = pa.array([table["gid"][0].as_py()] * len(at), table.schema.field("gid").type)
        labels = pa.array([table["label"][0].as_py()] * len(at), pa.string())
        return pa.table({"gid": gids, "label": labels, "cell": pa.array(at.astype(np.int32)), "low": low[at], "high": high[at]})

    return grouped.groupBy("gid").applyInArrow(run, f"gid {gid}, label string, cell int, low double, high double")


def _blocks(rows: DataFrame, reach: DataFrame, grouped: DataFrame, same_label: bool, block: int, join, schema: str) -> DataFrame:
    """The exact join of every group with the rows of its cells that lie in its rings."""
    keys = ["label", "cell"] if same_label else ["cell"]
    reach = reach if same_label else reach.drop("label")
    held = rows.groupBy(*keys).agg(F.count("*").alias("held"))
    salts = F.greatest(F.lit(1), F.ceil(F.sum("held") / block)).cast("int").alias("salts")
    plan = reach.join(held, keys).groupBy("gid").agg(salts)
    sent = rows.join(reach.join(plan, "gid"), keys).filter("apart BETWEEN low AND high")
    sent = sent.select("gid", F.pmod(F.xxhash64("vec_id"), F.col("salts")).cast("int").alias("salt"), "vec_id", "label", "v")
    asked = grouped.join(plan, "gid").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts", "cell")
    asked = asked.select([F.col(c).alias(c) for c in asked.columns])  # else both sides have columns of one table
    return sent.groupBy("gid", "salt").cogroup(asked.groupBy("gid", "salt")).applyInArrow(join, schema)


def _scores(left: pa.Table, right: pa.Table, dims: int):
    """Rows of a block sorted by id, and for each anchor (its place, exact scores with its own id ruled out)."""
    ids = left["vec_id"].to_numpy()
    order = np.argsort(ids, kind="stable")
    x, q, who = integers.matrix(left["v"], dims)[order], integers.matrix(right["v"], dims), right["vec_id"].to_numpy()
    ids = ids[order]

    def each():
        for a in range(0, len(q), 128):
            s = q[a : a + 128] @ x.T
            s[who[a : a + 128, None] == ids[None]] = -np.inf
            for i, row in enumerate(s):
                yield a + i, row

    return ids, order, each()


def first_ids(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` first by score, ties to the smaller id, each id once; ``ids`` ascend."""
    at = np.arange(len(scores))
    if len(scores) > 4 * k:
        edge = np.partition(scores, len(scores) - 2 * k)[len(scores) - 2 * k]
        some = np.flatnonzero(scores >= edge)
        if len(np.unique(ids[some])) >= k:
            at = some
    at = at[np.lexsort((ids[at], -scores[at]))]
    if len(at) > 1 and len(np.unique(ids[at])) < len(at):
        at = at[np.sort(np.unique(ids[at], return_index=True)[1])]
    return at[:k]


def _columns(parts: list[tuple], names: str) -> pa.Table:
    """Rows from lists of equally long arrays."""
    whole = [np.concatenate([np.asarray(p[i]) for p in parts]) if parts else np.zeros(0) for i in range(len(names.split()))]
    return pa.table({n: pa.array(a.astype(np.int64)) for n, a in zip(names.split(), whole, strict=True)})


def _top(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The first ``k`` ids of each ``by`` with their ``rank``."""
    found = found.groupBy(*by, "vec_id").agg(F.max("score").alias("score"))
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= k)


def _two_steps(rows: DataFrame, anchors: DataFrame, by: list[str], cells: Cells, dims: int, group: int, block: int, join, schema: str, bounds) -> DataFrame:
    """Search anchors in their own cells, then in whatever other cells ``bounds`` (of what was found) leaves them."""
    same_label = "label" in by
    grouped = store.written(_grouped(anchors, by, group), "grouped")
    home = grouped.select("gid", "label", "cell", F.lit(0.0).alias("low"), F.lit(float("inf")).alias("high")).distinct() if same_label else grouped.select("gid", F.lit("").alias("label"), "cell", F.lit(0.0).alias("low"), F.lit(float("inf")).alias("high")).distinct()
    near = store.written(_blocks(rows, home, grouped, same_label, block, join, schema), "near")
    bounded = bounds(grouped, near)
    reach = store.written(_reach(bounded, cells, dims), "reach")
    far = _blocks(rows, reach, bounded.drop("least", "most"), same_label, block, join, schema)
    return near.union(far)


def mine(vectors: DataFrame, is_anchor, positives: int = POSITIVES, negatives: int = NEGATIVES, group: int = GROUP, block: int = BLOCK) -> DataFrame:
    """RESULT's columns for the rows of ``vectors`` (vec_id, label, v, square) that satisfy the column ``is_anchor``."""
    spark = vectors.sparkSession
    rows = vectors.filter("vec_id IS NOT NULL AND label IS NOT NULL").withColumn("label", F.col("label").cast("string"))
    dims, most = rows.agg(F.max(F.size("v")), F.max("square")).first()
    if dims is None:
        return spark.createDataFrame([], RESULT)
    rows = rows.select("vec_id", "label", integers.padded(F.col("v"), dims).alias("v"))
    one = rows.filter(is_anchor).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("row")).select("vec_id", "row.*")
    total = one.count()
    if not total:
        return spark.createDataFrame([], RESULT)
    cells = pivots(rows, total, dims, float(most))
    homed = store.written(_homed(rows, cells, dims, anchors=False), "homed")
    anchors = store.written(_homed(one, cells, dims, anchors=True), "anchors")

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            who = right["vec_id"].to_numpy()
            ids, _, each = _scores(left, right, dims)
            for i, s in each:
                at = first_ids(ids, s, positives)
                at = at[np.isfinite(s[at])]
                out.append((np.full(len(at), who[i]), ids[at], s[at]))
        return _columns(out, "anchor_id vec_id score")

    def edges(grouped: DataFrame, near: DataFrame) -> DataFrame:
        """The score of the last positive found, if there are enough of them."""
        last = _top(near, ["anchor_id"], positives).filter(F.col("rank") == positives).select(F.col("anchor_id").alias("vec_id"), F.col("score").cast("double").alias("least"))
        never, ever = F.lit(float("-inf")), F.lit(float("inf"))
        return grouped.join(last, "vec_id", "left").withColumns({"least": F.coalesce("least", never), "most": ever})

    found = _two_steps(homed, anchors, ["label", "cell"], cells, dims, group, block, nearest, "anchor_id long, vec_id long, score long", edges)
    pairs = store.written(_top(found, ["anchor_id"], positives).select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "pairs")
    # Distinct positive scores of each anchor: a positive under 0 has no negatives.
    windows = pairs.filter("positive_score >= 0").groupBy(F.col("anchor_id").alias("vec_id")).agg(F.sort_array(F.collect_set("positive_score")).alias("wanted"))

    def below(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            codes = pd.factorize(np.concatenate((left["label"].to_numpy(zero_copy_only=False), right["label"].to_numpy(zero_copy_only=False))))[0]
            who, wanted = right["vec_id"].to_numpy(), right["wanted"].to_pylist()
            ids, order, each = _scores(left, right, dims)
            labels, own = codes[: len(order)][order], codes[len(order) :]
            for i, s in each:
                p = np.array(wanted[i])
                some = np.flatnonzero((2 * s >= p.min()) & (20 * s <= 19 * p.max()) & (labels != own[i]))
                for score in p:
                    fit = some[(2 * s[some] >= score) & (20 * s[some] <= 19 * score)]
                    at = fit[first_ids(ids[fit], s[fit], negatives)]
                    out.append((np.full(len(at), who[i]), np.full(len(at), score), ids[at], s[at]))
        return _columns(out, "anchor_id positive_score vec_id score")

    def window(grouped: DataFrame, near: DataFrame) -> DataFrame:
        """From the lowest score that a window may still need, to the highest that any allows."""
        full = _top(near, ["anchor_id", "positive_score"], negatives).filter(F.col("rank") == negatives)
        full = full.select(F.col("anchor_id").alias("vec_id"), "positive_score", "score")
        asked = grouped.select("vec_id", F.explode("wanted").alias("positive_score")).join(full, ["vec_id", "positive_score"], "left")
        least = F.min(F.coalesce(F.col("score").cast("double"), F.col("positive_score") / 2)).alias("least")
        return grouped.join(asked.groupBy("vec_id").agg(least, F.max(F.col("positive_score") * 19 / 20).alias("most")), "vec_id")

    searched = anchors.join(windows, "vec_id")
    found = _two_steps(homed, searched, ["cell"], cells, dims, group, block, below, "anchor_id long, positive_score long, vec_id long, score long", window)
    best = _top(found, ["anchor_id", "positive_score"], negatives).withColumnRenamed("vec_id", "negative_id").withColumnRenamed("score", "negative_score")
    return pairs.join(best, ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", F.col("rank").cast("int"), "negative_id", "positive_score", "negative_score")


def oracle() -> str:
    """DuckDB SQL of the query: every anchor against every row."""
    return f"""WITH kept AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda e: floor(256 * CAST(e AS DOUBLE))) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: isfinite(e))) = len(embedding)),
scored AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CAST(list_inner_product(a.x, r.x) AS BIGINT) AS score
  FROM kept a JOIN kept r ON a.vec_id <> r.vec_id WHERE a.vec_id % 50 = 0),
positive AS MATERIALIZED (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES})
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM positive JOIN scored USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= {NEGATIVES}"""
