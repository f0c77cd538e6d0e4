"""Operator 13: k-means in whole numbers by Hamerly's bounds.

Vectors are floor(256 * x). Each carries its cluster, an upper bound of the
distance to its own centroid and a lower bound of the distance to the nearest
other one. After a round the centroids have drifted: the upper bound grows by the
drift of the own centroid, the lower one shrinks by the largest drift of the
others. Where the upper bound stays under the lower one, or under half the gap
from the own centroid to its nearest neighbour, the cluster stands; if not, the own distance is
measured exactly; only what is still ambiguous meets all centroids, in exact
integers, ties to the smaller number.

One pass a round writes vectors and bounds to the shared folder, and one over the
vectors that changed cluster sums what moved: a task returns one row for each
cluster it saw, so the driver gets ``k`` times the dimensions numbers however many
vectors there are. Bounds are widened by a margin far above their rounding.

Defined results: vectors without exactly ``dimensions`` components or with a null
or non-finite one are left out. With fewer than ``k`` vectors each is a
centroid; without any there are no rows. Repeated rows are rows of their own; those
of one id may both be centroids, the smaller vector first. Rows with a null id are
clustered and returned too, last in the order of starting centroids. Extra columns
are ignored. Vectors of a length beyond about 131,000 are an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm import integers, store

K, ROUNDS, SEED, DIMENSIONS = 40, 5, 2, 64
#: Relative margin of the bounds; doubles round by about 1e-16.
MARGIN = 1e-9
STATE = "vec_id long, v array<int>, cluster int, was int, upper double, lower double, scanned boolean"
RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


@dataclass
class Centroids:
    """Centroids of a round, how far each has drifted since the last one, and half its gap to the nearest other."""

    at: np.ndarray
    drift: np.ndarray
    others: np.ndarray
    gap: np.ndarray

    @staticmethod
    def of(at: np.ndarray, before: np.ndarray | None = None) -> Centroids:
        """Bounds' data of centroids that stood at ``before``."""
        drift = np.sqrt(((at - (at if before is None else before)) ** 2).sum(1))
        order = np.argsort(-drift, kind="stable")
        others = np.full(len(at), drift[order[0]])
        others[order[0]] = drift[order[1]] if len(at) > 1 else 0.0
        apart = squares(at.astype(float), at)
        np.fill_diagonal(apart, np.inf)
        return Centroids(at, drift, others, np.sqrt(apart.min(1)) / 2)


def squares(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centroids; whole numbers, exact."""
    c = at.astype(float)
    return (x * x).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * (x @ c.T)


def settle(x: np.ndarray, c: Centroids, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, ...]:
    """New cluster and bounds of rows with the bounds of the last round, and which rows met all centroids.

    A cluster of -1 has no bounds yet.
    """
    cluster, fresh = cluster.copy(), cluster < 0
    own = np.where(fresh, 0, cluster)
    upper = np.where(fresh, np.inf, upper + c.drift[own])
    lower = np.where(fresh, 0.0, lower - c.others[own])
    edge = np.maximum(lower, c.gap[own]) * (1 - MARGIN)
    near = np.flatnonzero(~fresh & ~(upper * (1 + MARGIN) < edge))
    upper[near] = np.sqrt(((x[near] - c.at[own[near]]) ** 2).sum(1))
    open_ = fresh | ~(upper * (1 + MARGIN) < edge)
    if len(rows := np.flatnonzero(open_)):
        d = squares(x[rows], c.at)
        best = d.argmin(1)  # the first of equals
        cluster[rows] = best
        upper[rows] = np.sqrt(d[np.arange(len(rows)), best])
        d[np.arange(len(rows)), best] = np.inf
        lower[rows] = np.sqrt(d.min(1))
    return cluster, upper, lower, open_


def _pass(state: DataFrame, c: Centroids) -> DataFrame:
    """The rows of ``state`` with clusters and bounds under ``c``."""
    shared, dims = state.sparkSession.sparkContext.broadcast(c), c.at.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            was = b["cluster"].to_numpy(zero_copy_only=False)
            got = settle(integers.matrix(b["v"], dims), shared.value, was, b["upper"].to_numpy(zero_copy_only=False), b["lower"].to_numpy(zero_copy_only=False))
            new, upper, lower, scanned = (pa.array(a) for a in got)
            yield pa.RecordBatch.from_arrays([b["vec_id"], b["v"], new.cast("int32"), b["cluster"], upper, lower, scanned], names=["vec_id", "v", "cluster", "was", "upper", "lower", "scanned"])

    return state.mapInArrow(run, STATE)


def moved_sums(state: DataFrame, k: int, dims: int) -> np.ndarray:
    """What each cluster gained less what it lost in the last pass: sums of components, and a count at the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((k, dims + 1), np.int64), False
        for b in batches:
            x, seen = integers.matrix(b["v"], dims), True
            x = np.concatenate((x, np.ones((len(x), 1))), 1).astype(np.int64)
            for column, sign in (("cluster", 1), ("was", -1)):
                at = b[column].to_numpy(zero_copy_only=False)
                np.add.at(total, at[at >= 0], sign * x[at >= 0])
        live = np.flatnonzero(total.any(1)) if seen else np.zeros(0, int)
        yield pa.RecordBatch.from_arrays([pa.array(live.astype(np.int32)), pa.array(total[live].tolist(), pa.list_(pa.int64()))], names=["cluster", "sums"])

    parts = state.filter("cluster <> was").select("v", "cluster", "was").mapInArrow(run, "cluster int, sums array<long>")
    out = np.zeros((k, dims + 1), np.int64)
    for r in parts.select("cluster", F.posexplode("sums").alias("i", "part")).groupBy("cluster", "i").agg(F.sum("part").alias("total")).collect():  # k * (dims + 1) rows
        out[r["cluster"], r["i"]] = r["total"]
    return out


def start(vectors: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The ``k`` vectors whose ids have the smallest sha256 of ``seed:id``."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = vectors.select(h.alias("h"), "v").orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()  # k rows
    return np.array([r["v"] for r in first], np.int64)


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """Cluster ``vectors`` (vec_id, v: integers of equal dimensions): RESULT's columns, a row a vector."""
    spark = vectors.sparkSession
    vectors = vectors.select("vec_id", "v")
    at = start(vectors, k, seed)
    if not len(at):
        return spark.createDataFrame([], RESULT)
    k, dims = at.shape
    state = vectors.select("vec_id", "v", F.lit(-1).alias("cluster"), F.lit(-1).alias("was"), F.lit(0.0).alias("upper"), F.lit(0.0).alias("lower"), F.lit(True).alias("scanned"))
    sums, before, last = np.zeros((k, dims + 1), np.int64), None, None
    for _ in range(rounds + 1):
        state = store.written(_pass(state, Centroids.of(at, before)), "bounds")
        if last is not None:
            store.drop(last)
        last = state
        if _ == rounds:
            break
        sums += moved_sums(state, k, dims)
        before, at = at, np.where(sums[:, -1:] > 0, sums[:, :-1] // np.maximum(sums[:, -1:], 1), at)  # // floors
    own = F.lit(0).cast("long")
    shared = spark.createDataFrame([(i, [int(x) for x in c], hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(at.tolist())], "cluster int, c array<long>, centroid_sha256 string")
    own = F.aggregate(F.zip_with("v", "c", lambda a, b: (a - b) * (a - b)), own, lambda a, b: a + b)
    measured = state.join(F.broadcast(shared), "cluster").select("vec_id", "cluster", own.alias("distance"), "centroid_sha256")  # k rows broadcast
    totals = [(r["cluster"], r["t"]) for r in measured.groupBy("cluster").agg(F.sum("distance").alias("t")).collect()]  # k rows
    inertia = sum(t for _, t in totals)
    sums_of = spark.createDataFrame([(c, t, inertia) for c, t in totals], "cluster int, cluster_inertia long, inertia long")
    out = measured.join(F.broadcast(sums_of), "cluster")  # k rows broadcast
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(k: int = K, rounds: int = ROUNDS, seed: int = SEED, dimensions: int = DIMENSIONS) -> str:
    """DuckDB SQL of the query: Lloyd's rounds one after another, every vector against every centroid."""
    apart = "list_inner_product(a.x, a.x) + list_inner_product(c.x, c.x) - 2 * list_inner_product(a.x, c.x)"
    parts = [
        f"""kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda e: floor(256 * CAST(e AS DOUBLE))) AS x FROM embeddings
  WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda e: isfinite(e))) = {dimensions})""",
        f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256(concat('{seed}:', vec_id)), x) - 1 AS c, x FROM kept QUALIFY c < {k})""",
    ]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS MATERIALIZED (
  SELECT a.vec_id, a.x, c.c, CAST({apart} AS BIGINT) AS distance FROM kept a, c{r} c
  QUALIFY row_number() OVER (PARTITION BY a.vec_id, a.x ORDER BY distance, c.c) = 1)""")
        if r < rounds:
            parts.append(f"""s{r} AS MATERIALIZED (
  SELECT c, i, CAST(sum(CAST(x[i] AS BIGINT)) AS BIGINT) AS s, count(*) AS n FROM a{r}, range(1, {dimensions + 1}) t(i) GROUP BY ALL)""")
            parts.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY i) AS x FROM s{r} GROUP BY c
  UNION ALL SELECT c, x FROM c{r} WHERE c NOT IN (SELECT c FROM s{r}))""")
    return f"""WITH {", ".join(parts)},
named AS (SELECT c, sha256(array_to_string(list_transform(x, lambda e: CAST(CAST(e AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256 FROM c{rounds})
SELECT vec_id, CAST(c AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM a{rounds} JOIN named USING (c)"""
