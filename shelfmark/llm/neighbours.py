"""Operator 8: approximate nearest neighbours by learned partitions.

On a bounded sample the neighbour graph (each vector's nearest by inner product)
is cut into balanced parts by capacity-bound label propagation, and a small
network (one hidden layer) learns to tell the part of a vector and of its
neighbours. Every vector is indexed under its most probable part; a query is
routed to several most probable parts, as many as reach ``target`` recall on
vectors held out of the sample (and at least ``k`` candidate ids), and is
reranked there exactly.

There are 1.5 times as many parts as the square root of the rows, MOST_PARTS at most:
so many one router tells apart. Where parts would then hold more than
``rows_per_part`` rows on average there are two levels: every part of the first has a
sample and a router of its own, learnt in a task. (Beyond MOST_PARTS squared times
rows_per_part, 33 million rows, parts grow with the table.) Only a table without
16 distinct vectors has one part.

Parts lie in buckets of up to BLOCK_ROWS rows, searched by BLOCK_QUERIES queries at a
time; a part beyond that is a bucket of its own, dealt to several blocks, so one that holds a
third of all rows is many tasks. A query is sent once to each bucket that holds
parts it visits, and meets only these parts' rows there. The more probable quarter of its
parts is searched first; a query's k-th best score there
is an edge that candidates of its other parts must reach to leave their task, so
what is merged stays near k rows a query however many parts it visits. A block
keeps each query's k nearest ids at most. Scores are double-precision sums over the original
components, all by the same routine, so equal vectors get equal scores; ties go
to the smaller vec_id.

Defined results: vectors that are null, zero, or hold null or non-finite
components take no part, nor do null ids; shorter vectors count as filled up with
zeros. Fewer than k candidates give them all. Repeated rows of one id count once
(the largest score). No vectors give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm import store

K = 20
SAMPLE, GRAPH_K, HIDDEN = 4096, 12, 64
#: One in so many vectors of the sample is held out to choose the number of probes.
HELD_OUT = 4
ROWS_PER_PART, MOST_PARTS = 2_000, 128
#: Parts of a small table: so many times the square root of its rows.
PARTS_BY_ROOT = 1.5
#: Distinct vectors of a sample that each part needs.
SAMPLE_PER_PART = 8
TARGET = 0.93
BLOCK_ROWS, BLOCK_QUERIES = 8_192, 1_024
#: Parts, at least, that give a query the score which candidates of later parts must reach.
FIRST_PARTS = 4


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v) of the vectors that take part."""
    v = F.col(embedding).cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.coalesce(good, F.lit(False)))
    longest, shortest = rows.agg(F.max(F.size("v")), F.min(F.size("v"))).first()
    if longest == shortest:
        return rows
    return rows.select("vec_id", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(longest) - F.size("v"))).alias("v"))


def nearest(x: np.ndarray, k: int) -> np.ndarray:
    """Row numbers of each row's k nearest other rows by inner product."""
    out = []
    for a in range(0, len(x), 512):
        s = x[a : a + 512] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        out.append(np.argsort(-s, 1, kind="stable")[:, :k])
    return np.concatenate(out)


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12, slack: float = 1.1, seed: int = 3) -> np.ndarray:
    """Part of each vertex: label propagation on the graph in which no part outgrows its share by ``slack``."""
    n, rng = len(x), np.random.default_rng(seed)
    most = int(np.ceil(n / parts * slack))
    # Start: halve along the widest of random directions, again and again.
    label = np.zeros(n, int)
    todo = [(np.arange(n), 0, parts)]
    while todo:
        rows, first, count = todo.pop()
        if count == 1:
            label[rows] = first
            continue
        half = count // 2
        directions = x[rng.choice(rows, min(16, len(rows)), replace=False)] - x[rows].mean(0) if len(rows) else x[:1]
        spread = x[rows] @ directions.T
        along = spread[:, spread.std(0).argmax()] if len(rows) else np.zeros(0)
        order = rows[np.argsort(along, kind="stable")]
        cut = len(rows) * half // count
        todo += [(order[:cut], first, half), (order[cut:], first + half, count - half)]
    links: list[list[int]] = [[] for _ in range(n)]
    for i, row in enumerate(graph):
        for j in row:
            links[i].append(j)
            links[j].append(i)
    size = np.bincount(label, minlength=parts)
    for _ in range(rounds):
        moved = 0
        for i in rng.permutation(n):
            votes = np.bincount(label[links[i]], minlength=parts).astype(float)
            votes[size >= most] = -1
            votes[label[i]] = max(votes[label[i]], np.count_nonzero(label[links[i]] == label[i]))
            best = int(votes.argmax())
            if votes[best] > votes[label[i]]:
                size[label[i]] -= 1
                size[best] += 1
                label[i] = best
                moved += 1
        if moved < n // 200:
            break
    return label


@dataclass
class Router:
    """A small network from a vector to the log-odds of its part."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    scale: float

    def parts(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each part for each row."""
        return np.maximum(x / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2


def train_router(x: np.ndarray, target: np.ndarray, epochs: int = 40, rate: float = 0.01, seed: int = 4) -> Router:
    """Fit by Adam to ``target``, the distribution of parts among a row and its neighbours."""
    rng = np.random.default_rng(seed)
    scale = float(np.sqrt((x * x).mean())) or 1.0
    d, parts = x.shape[1], target.shape[1]
    p = [rng.normal(size=(d, HIDDEN)) / np.sqrt(d), np.zeros(HIDDEN), rng.normal(size=(HIDDEN, parts)) / np.sqrt(HIDDEN), np.zeros(parts)]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for a in range(0, len(x), 256):
            at = order[a : a + 256]
            xb = x[at] / scale
            h = np.maximum(xb @ p[0] + p[1], 0)
            z = h @ p[2] + p[3]
            q = np.exp(z - z.max(1, keepdims=True))
            dz = (q / q.sum(1, keepdims=True) - target[at]) / len(at)
            dh = dz @ p[2].T * (h > 0)
            step += 1
            for w, mw, vw, g in zip(p, m, v, (xb.T @ dh, dh.sum(0), h.T @ dz, dz.sum(0)), strict=True):
                mw += 0.1 * (g - mw)
                vw += 0.001 * (g * g - vw)
                w -= rate * (mw / (1 - 0.9**step)) / (np.sqrt(vw / (1 - 0.999**step)) + 1e-8)
    return Router(*p, scale)


@dataclass
class Index:
    """A router, its number of parts and how many of them a query visits; without a router there is one part."""

    router: Router | None = None
    parts: int = 1
    probes: int = 1

    def order(self, x: np.ndarray) -> np.ndarray:
        """Parts of each row, most probable first."""
        if self.router is None:
            return np.zeros((len(x), 1), np.int64)
        return np.argsort(-self.router.parts(x), 1, kind="stable")


def learn(sample: np.ndarray, parts: int, k: int, target: float) -> Index:
    """Partitions of the distinct vectors of a sample; ``k`` is how many nearest of it are to be found."""
    distinct = np.unique(sample, axis=0) if len(sample) else sample  # copies teach nothing about the others
    parts = min(parts, len(distinct) // SAMPLE_PER_PART)
    if parts < 2:
        return Index()
    held = np.random.default_rng(2).permutation(len(distinct)) < len(distinct) // HELD_OUT
    x, unseen = distinct[~held], distinct[held]
    graph = nearest(x, min(GRAPH_K, len(x) - 1))
    label = balanced_parts(x, graph, parts)
    near = np.concatenate((np.arange(len(x))[:, None], graph), 1)
    soft = np.zeros((len(x), parts))
    np.add.at(soft, (np.repeat(np.arange(len(x)), near.shape[1]), label[near].ravel()), 1.0 / near.shape[1])
    router = train_router(x, soft)
    # The router has seen none of the held-out vectors: neither the queries nor their neighbours among them.
    rank = np.argsort(np.argsort(-router.parts(unseen), 1, kind="stable"), 1)  # of each part, for each row as a query
    home = router.parts(distinct).argmax(1)
    truth = nearest(distinct, min(k, len(distinct) - 1))[held]
    at = np.take_along_axis(rank, home[truth], 1)
    probes = next((p for p in range(1, parts + 1) if (at < p).mean() >= target), parts)
    return Index(router, parts, probes)


def found_in_sample(k: int, sample: int, total: int) -> int:
    """How many nearest of a sample stand for the k nearest of the table: its share of them, two at least."""
    return int(np.clip(-(-k * sample // max(1, total)), min(2, k), k))


@dataclass
class Levels:
    """The index of the first level and, of a large table, one for each of its parts."""

    top: Index
    below: dict[int, Index]
    width: int  # part numbers for each part of the first level

    def numbers(self) -> int:
        """Part numbers run below this."""
        return self.top.parts * (self.width if self.below else 1)

    def home(self, x: np.ndarray) -> np.ndarray:
        """Part number of each row."""
        first = self.top.order(x)[:, 0]
        if not self.below:
            return first
        out = first * self.width
        for p in np.unique(first):
            out[first == p] += self.below[int(p)].order(x[first == p])[:, 0]
        return out

    def routes(self, x: np.ndarray, sure: np.ndarray, k: int) -> list[np.ndarray]:
        """Part numbers that each query visits, more probable ones first; ``sure`` counts the ids that only that part has."""
        order = self.top.order(x)
        width = self.width if self.below else 1
        first = sure.reshape(-1, width).sum(1)
        visited = np.maximum(self.top.probes, (np.cumsum(first[order], 1) < k + 1).sum(1) + 1)
        if not self.below:
            return [parts[:n].astype(np.int32) for parts, n in zip(order, visited, strict=True)]
        out: list[list[np.ndarray]] = [[] for _ in x]
        for place in range(int(visited.max(initial=0))):
            at = np.where(visited > place, order[:, min(place, order.shape[1] - 1)], -1)
            for p in np.unique(at[at >= 0]):
                asks, own = np.flatnonzero(at == p), self.below[int(p)]
                for i, o in zip(asks, own.order(x[asks]), strict=True):
                    out[i].append(int(p) * width + o[: own.probes])
        for i, parts in enumerate(out):
            if sum(sure[q].sum() for q in parts) < k + 1:  # too few for sure: all parts below those visited
                out[i] = [p * width + np.arange(self.below[int(p)].parts) for p in order[i, : visited[i]]]
        return [np.concatenate(parts).astype(np.int32) for parts in out]


def _sampled(rows: DataFrame, share, sample: int, *by: str) -> DataFrame:
    """At most ``sample`` rows (of each value of ``by``), chosen by hash; ``share`` keeps somewhat more than that."""
    h = F.xxhash64("vec_id")
    some = rows.filter(F.pmod(h, F.lit(1 << 20)) <= share * (1 << 20))
    return some.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(h, "vec_id", "v"))).filter(F.col("_r") <= sample).drop("_r")


def fit(vectors: DataFrame, total: int, k: int = K, sample: int = SAMPLE, target: float = TARGET, rows_per_part: int = ROWS_PER_PART) -> Levels:
    """Learn partitions on ``sample`` vectors chosen by hash, and as many of each part where there are two levels."""
    two = total > MOST_PARTS * rows_per_part
    parts = min(MOST_PARTS, max(-(-total // rows_per_part), int(np.ceil(PARTS_BY_ROOT * np.sqrt(total)))))
    each = target ** 0.5 if two else target
    got = _sampled(vectors.withColumn("_all", F.lit(0)), min(1.0, 1.5 * sample / max(1, total)), sample, "_all").select("v").toArrow()["v"]
    x = np.array(got.to_pylist(), float) if len(got) else np.zeros((0, 1))  # ``sample`` rows at most
    top = Levels(learn(x, parts, found_in_sample(k, len(x), total), each), {}, MOST_PARTS)
    if not two or top.top.router is None:
        return top
    homed = store.written(_homed(vectors, top), "homed")
    sizes = {r["part"]: r["count"] for r in homed.groupBy("part").count().collect()}  # MOST_PARTS rows
    shares = vectors.sparkSession.createDataFrame([(p, min(1.0, 1.5 * sample / n), n) for p, n in sizes.items()], "part int, share double, n long")
    picked = _sampled(homed.join(F.broadcast(shares), "part"), F.col("share"), sample, "part")

    def below(group: pd.DataFrame) -> pd.DataFrame:
        n = int(group["n"].iloc[0])
        index = learn(np.stack(group["v"].to_numpy()), min(-(-n // rows_per_part), MOST_PARTS), found_in_sample(k, len(group), n), each)
        return pd.DataFrame({"part": [group["part"].iloc[0]], "index": [pickle.dumps(index)]})

    learnt = picked.groupBy("part").applyInPandas(below, "part int, index binary").collect()  # a model a part, MOST_PARTS at most
    store.drop(homed)
    return Levels(top.top, {p: Index() for p in range(top.top.parts)} | {r["part"]: pickle.loads(r["index"]) for r in learnt}, MOST_PARTS)


def _homed(vectors: DataFrame, levels: Levels) -> DataFrame:
    shared = vectors.sparkSession.sparkContext.broadcast(levels)

    def home(v: pd.Series) -> pd.Series:
        return pd.Series(shared.value.home(np.stack(v.to_numpy())).astype(np.int32) if len(v) else np.zeros(0, np.int32))

    return vectors.withColumn("part", F.pandas_udf(home, "int")("v"))


def search(vectors: DataFrame, queries: DataFrame, k: int = K, index: Levels | None = None, target: float = TARGET, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """Each query's k nearest vectors found: query_id, rank, vec_id, score.

    ``vectors`` and ``queries`` have columns vec_id and v (see :func:`usable`).
    """
    spark = vectors.sparkSession
    index = index or fit(vectors, vectors.count(), k, target=target, rows_per_part=rows_per_part)
    homed = store.written(_homed(vectors, index), "homed")
    # Rows of each part, and its ids that no other part has: so many candidates are sure.
    sizes, sure = (np.zeros(index.numbers(), np.int64) for _ in range(2))
    spread = homed.groupBy("vec_id", "part").count().groupBy("vec_id").agg(F.collect_list(F.struct("part", "count")).alias("at"))
    spread = spread.select((F.size("at") == 1).alias("only"), F.explode("at").alias("at")).groupBy("at.part")
    for r in spread.agg(F.sum("at.count").alias("n"), F.count_if("only").alias("sure")).collect():  # a row for each part
        sizes[r["part"]], sure[r["part"]] = r["n"], r["sure"]
    bucket, salts = buckets(sizes)
    shared = spark.sparkContext.broadcast((index, sure, bucket))

    def route(v: pd.Series) -> pd.Series:
        own, known, bucket_of = shared.value
        out = []
        for parts in own.routes(np.stack(v.to_numpy()), known, k) if len(v) else []:
            asks = []
            first = max(FIRST_PARTS, -(-len(parts) // 4))
            for later, some in enumerate((parts[:first], parts[first:])):
                at = bucket_of[some]
                asks += [{"later": bool(later), "bucket": int(b), "parts": some[at == b].tolist()} for b in np.unique(at)]
            out.append(asks)
        return pd.Series(out, dtype=object)

    asks = F.pandas_udf(route, "array<struct<later boolean, bucket int, parts array<int>>>")("v")
    asked = store.written(queries.select("vec_id", "v", F.explode(asks).alias("ask")).select("vec_id", "v", "ask.*", F.lit(None).cast("double").alias("edge")), "asked")
    # The first parts give each query an edge, its k-th best score so far; later parts return only what reaches it.
    near = _nearest_of(_reranked(homed, asked.filter("NOT later"), bucket, salts, k, "first"), k)
    near = store.written(near, "near")
    edges = near.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("edge"))
    later = asked.filter("later").drop("edge").join(edges, "vec_id", "left")
    far = _reranked(homed, later, bucket, salts, k, "later")
    return _nearest_of(near.select("query_id", "vec_id", "score").union(far), k)


def buckets(sizes: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each part, and the salts of each bucket: neighbouring parts share one of up to ``most`` rows, a larger part has one of its own, dealt to salts."""
    most = most or BLOCK_ROWS
    bucket, salts, held = np.zeros(len(sizes), np.int64), [], 0
    for p, n in enumerate(sizes):
        if not salts or held + n > most:
            salts.append(max(1, -(-int(n) // most)))
            held = 0
        bucket[p] = len(salts) - 1
        held += n
    return bucket, np.array(salts)


def _nearest_of(found: DataFrame, k: int) -> DataFrame:
    """Each query's k nearest ids among what blocks found: query_id, rank, vec_id, score."""
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _reranked(homed: DataFrame, asked: DataFrame, bucket: np.ndarray, salts: np.ndarray, k: int, stage: str) -> DataFrame:
    """(query_id, vec_id, score) of each query's k nearest ids of every block of the parts it asks, from its edge on.

    A bucket's candidates are dealt to salts, its queries to chunks; each pair of them is a block. In a block
    a query meets only the rows of the parts that it asks.
    """
    spark = homed.sparkSession
    asks = {r["bucket"]: r["count"] for r in asked.groupBy("bucket").count().collect()}  # a row for each bucket
    chunks = {b: -(-n // BLOCK_QUERIES) for b, n in asks.items()}
    parts = spark.createDataFrame([(p, int(b), int(salts[b]), chunks[b]) for p, b in enumerate(bucket) if b in chunks], "part int, bucket int, salts int, chunks int")
    plan = spark.createDataFrame([(b, int(salts[b]), n) for b, n in chunks.items()], "bucket int, salts int, chunks int")
    hashed, upto = F.xxhash64("vec_id"), lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    cand = homed.join(F.broadcast(parts), "part").select("bucket", "part", "vec_id", "v", F.pmod(hashed, F.col("salts")).cast("int").alias("salt"), upto("chunks").alias("chunk"))  # MOST_PARTS squared rows at most
    queries = asked.join(F.broadcast(plan), "bucket").select("bucket", "parts", "vec_id", "v", "edge", upto("salts").alias("salt"), F.pmod(hashed, F.col("chunks")).cast("int").alias("chunk"))

    def rerank(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(left) and len(right):
            x, q = np.stack(left["v"].to_numpy()), np.stack(right["v"].to_numpy())
            ids, asked_by, part = left["vec_id"].to_numpy(), right["vec_id"].to_numpy(), left["part"].to_numpy()
            least = right["edge"].to_numpy(dtype=float, na_value=np.nan)
            by_id = np.argsort(ids, kind="stable")
            x, ids, part = x[by_id], ids[by_id], part[by_id]
            first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))  # of each id's rows
            rough = np.full((len(q), len(x)), -np.inf)
            who, what = np.repeat(np.arange(len(q)), [len(p) for p in right["parts"]]), np.concatenate(right["parts"].to_numpy())
            for p in np.unique(part):
                rows, held = who[what == p], np.flatnonzero(part == p)
                rough[np.ix_(rows, held)] = q[rows] @ x[held].T
            rough[asked_by[:, None] == ids[None]] = -np.inf
            for row, vector, who, bound in zip(rough, q, asked_by, np.where(np.isnan(least), -np.inf, least), strict=True):
                tops = row if len(first) == len(row) else np.maximum.reduceat(row, first)  # the best of each id
                edge = max(bound, np.partition(tops, len(tops) - k)[len(tops) - k] if len(tops) > k else -np.inf)
                # Matrix products differ in their last bits by position: all within reach are summed anew.
                reach = np.flatnonzero((row >= edge - 1e-9 * max(1.0, abs(edge)) if np.isfinite(edge) else row > -np.inf) & np.isfinite(row))
                exact = (x[reach] * vector).sum(1)
                order = np.lexsort((ids[reach], -exact))
                best, exact = reach[order], exact[order]
                if len(first) < len(row):
                    kept = np.sort(np.unique(ids[best], return_index=True)[1])
                    best, exact = best[kept], exact[kept]
                best, exact = best[:k][exact[:k] >= bound], exact[:k][exact[:k] >= bound]
                out.append((np.full(len(best), who), ids[best], exact))
        return pd.DataFrame({name: np.concatenate([o[i] for o in out]) for i, name in enumerate(("query_id", "vec_id", "score"))})

    rerank.__name__ = f"rerank_{stage}"
    keys = ["bucket", "salt", "chunk"]
    return cand.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInPandas(rerank, "query_id long, vec_id long, score double")
