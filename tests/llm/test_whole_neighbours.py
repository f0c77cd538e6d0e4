import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import neighbours


def test_repeats_of_one_id_take_one_slot(spark):
    rows = [(0, [1.0, 0.0])] + [(1, [1.0, 0.01])] * 30 + [(i, [1.0 - i / 100, 0.0]) for i in range(2, 40)]
    usable = neighbours.usable(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    out = neighbours.search(usable, usable.filter("vec_id = 0")).orderBy("rank").collect()
    assert [r.vec_id for r in out] == list(range(1, 21))


def test_recall_on_a_table_beyond_the_sample(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 16))
    x = (centres[np.arange(12_000) % 40] + 0.6 * rng.normal(size=(12_000, 16))).astype(np.float32)
    usable = neighbours.usable(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>"))
    found = {}
    for r in neighbours.search(usable, usable.filter(F.col("vec_id") % 100 == 0)).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    exact = x.astype(float) @ x.astype(float).T
    np.fill_diagonal(exact, -np.inf)
    recall = np.mean([len(found[q] & set(np.argsort(-exact[q])[:20].tolist())) / 20 for q in range(0, 12_000, 100)])
    print("recall", recall)
    assert recall >= 0.9


def test_two_levels_on_a_table_beyond_the_sample(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "MOST_PARTS", 8)
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(60, 16))
    x = (centres[np.arange(8_000) % 60] + 0.5 * rng.normal(size=(8_000, 16))).astype(np.float32)
    usable = neighbours.usable(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>"))
    levels = neighbours.fit(usable, 8_000, sample=1_000, rows_per_part=200)
    assert len(levels.below) == 8 and sum(i.parts for i in levels.below.values()) > 30
    visited = levels.routes(x[:200].astype(float), np.full(levels.numbers(), 100), 20)
    assert np.mean([len(v) for v in visited]) < 0.7 * sum(i.parts for i in levels.below.values())
    found = {}
    for r in neighbours.search(usable, usable.filter(F.col("vec_id") % 40 == 0), index=levels).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    exact = x.astype(float) @ x.astype(float).T
    np.fill_diagonal(exact, -np.inf)
    recall = np.mean([len(found[q] & set(np.argsort(-exact[q])[:20].tolist())) / 20 for q in range(0, 8_000, 40)])
    print("recall", recall)
    assert recall >= 0.9


def test_vectors_of_two_lengths(spark):
    usable = neighbours.usable(spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>"))
    out = neighbours.search(usable, usable.filter("vec_id = 0")).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in out] == [(1, 3.0), (2, 3.0)]


@pytest.mark.parametrize(("sf", "parts"), [("sf0.01", 30), ("sf0.1", 60)])
def test_given_tables_are_searched_by_parts(spark, sf, parts):
    """The given vectors are random directions: no partition can spare much of them, but parts decide what is met."""
    usable = neighbours.usable(spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet"))
    rows = usable.orderBy("vec_id").collect()
    x, ids = np.array([r.v for r in rows]), np.array([r.vec_id for r in rows])
    index = neighbours.fit(usable, len(x))
    assert index.top.parts >= parts and index.top.router is not None and index.top.probes < index.top.parts
    home, ask = index.home(x), np.flatnonzero(ids % 20 == 0)
    assert np.bincount(home, minlength=parts).max() < 0.25 * len(x)
    routes = index.routes(x[ask], np.bincount(home, minlength=index.numbers()), 20)
    visited = [np.isin(home, r).mean() for r in routes]
    exact = x[ask] @ x.T
    exact[np.arange(len(ask)), ask] = -np.inf
    found = {}
    for r in neighbours.search(usable, usable.filter("vec_id % 20 = 0")).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    recall, met = [], []
    for q, s, route in zip(ask, exact, routes, strict=True):
        near = ids[np.argsort(-s, kind="stable")[:20]]
        own = sorted(found[ids[q]])
        recall.append(len({v for _, v, _ in own} & set(near.tolist())) / 20)
        # Exactly the nearest of the parts that the query visits.
        s = np.where(np.isin(home, route), s, -np.inf)
        met.append([v for _, v, _ in own] == ids[np.argsort(-s, kind="stable")[:20]].tolist())
    print(sf, "parts", index.top.parts, "recall", np.mean(recall), "visited", np.mean(visited))
    assert all(met) and np.mean(recall) >= 0.9 and np.mean(visited) < 0.9


def test_clustered_vectors_visit_few_parts(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(30, 32))
    x = (centres[np.arange(2_000) % 30] + 0.3 * rng.normal(size=(2_000, 32))).astype(np.float32).astype(float)
    usable = neighbours.usable(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"))
    index = neighbours.fit(usable, len(x))
    home = index.home(x)
    routes = index.routes(x[::20], np.bincount(home, minlength=index.numbers()), 20)
    visited = np.mean([np.isin(home, r).mean() for r in routes])
    found = {}
    for r in neighbours.search(usable, usable.filter("vec_id % 20 = 0"), index=index).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    exact = x @ x.T
    np.fill_diagonal(exact, -np.inf)
    recall = np.mean([len(found[q] & set(np.argsort(-exact[q])[:20].tolist())) / 20 for q in range(0, 2_000, 20)])
    print("parts", index.top.parts, "visited", visited, "recall", recall)
    assert visited < 0.35 and recall >= 0.9


def test_ties_and_clashing_names(spark):
    """All vectors equal: the smallest ids win; columns named like the operator's own don't matter."""
    rows = [(i, [1.0, 2.0], 1, 2, "x", 0.5, 3) for i in range(300)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, part int, bucket int, v string, score double, rank int")
    usable = neighbours.usable(table)
    out = neighbours.search(usable, usable.filter("vec_id % 100 = 0")).orderBy("query_id", "rank").collect()
    for q in (0, 100, 200):
        assert [r.vec_id for r in out if r.query_id == q] == [i for i in range(21) if i != q][:20]


def test_buckets_hold_neighbouring_parts():
    bucket, salts = neighbours.buckets(np.array([3, 4, 5, 30, 1, 1]), 10)
    assert bucket.tolist() == [0, 0, 1, 2, 3, 3] and salts.tolist() == [1, 1, 3, 1]
