"""Operators 11 and 13: whole-number vectors, hard negatives, clusters."""

import hashlib

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from shelfmark.llm import centroids, integers, negatives

SCHEMA = "vec_id long, label int, embedding array<float>, cell int, v string, gid int, salt int, score string, rank int, cluster string, upper int"
CLASH = (7, "v", 1, 1, "s", 1, "c", 1)


def table(spark, rows):
    return spark.createDataFrame([(i, lab, None if x is None else [None if c is None else float(c) for c in x], *CLASH) for i, lab, x in rows], SCHEMA).repartition(3)


def best_first(x, rows, i, fits):
    """(score, id) of rows whose label fits, best first, each other id once."""
    best = {}
    for j, lab, y in rows:
        if j != i and fits(lab):
            s = sum(a * b for a, b in zip(x, y, strict=True))
            best.setdefault(j, []).append(s)
    return best


def mined(rows, every=50):
    """Brute force: (anchor, positive, rank, negative, positive score, negative score)."""
    good = [(i, lab, [int(np.floor(256 * np.float64(np.float32(c)))) for c in x]) for i, lab, x in rows if i is not None and lab is not None and x is not None and all(c is not None and np.isfinite(c) for c in x)]
    dims = max((len(x) for *_, x in good), default=0)
    good = [(i, lab, x + [0] * (dims - len(x))) for i, lab, x in good]
    anchors = {}
    for i, lab, x in good:
        if i % every == 0:
            anchors[i] = min(anchors.get(i, (str(lab), x)), (str(lab), x))
    out = []
    for i, (lab, x) in anchors.items():
        same, other = best_first(x, good, i, lambda a: str(a) == lab), best_first(x, good, i, lambda a: str(a) != lab)
        for p, j in sorted(((-max(s), j) for j, s in same.items()))[:5]:
            fit = {k: max(c, default=None) for k, s in other.items() if (c := [n for n in s if 50 * -p <= 100 * n <= 95 * -p])}
            for r, (n, k) in enumerate(sorted((-n, k) for k, n in fit.items())[:3]):
                out.append((i, j, r + 1, k, -p, -n))
    return sorted(out)


def run(spark, rows, **more):
    got = negatives.mine(integers.whole(table(spark, rows), "vec_id", "label"), F.col("vec_id") % 50 == 0, **more)
    assert [f.simpleString() for f in got.schema] == [c.replace(" ", ":").replace("long", "bigint") for c in negatives.RESULT.split(", ")]
    return sorted(tuple(r) for r in got.collect())


def clustered(n, dims=16, centres=12, seed=1, spread=0.25):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dims))
    return c[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, dims))


def test_negatives_match_brute_force(spark):
    x = clustered(900)
    rows = [(i, i % 7 % 3, v.tolist()) for i, v in enumerate(x)]
    rows += [(900, None, [1.0] * 16), (None, 1, [1.0] * 16), (950, 1, None), (951, 1, [float("nan")] * 16), (952, 1, [None] * 16), (1000, 1, [0.0] * 16), (953, 1, [float("inf")] * 16)]
    rows += [(j, 1, x[0].tolist()) for j in range(1001, 1041)]  # ties
    rows += [(7, 1, x[7].tolist())] * 3 + [(8, 2, x[9].tolist()), (50, 0, x[3].tolist())]  # repeated rows, one id with two vectors
    assert run(spark, rows) == mined(rows)
    assert run(spark, rows, group=3, block=40) == mined(rows)


def test_negatives_of_little(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, 1, [1.0])]) == []
    assert run(spark, [(50, 1, [1.0, 2.0])]) == []
    assert run(spark, [(50, 1, [])]) == []
    few = [(50, 1, [1.0, 1.0]), (51, 1, [1.0]), (52, 2, [0.9, 0.0]), (53, 3, [0.8]), (54, 2, [0.1, 0.1])]
    assert run(spark, few) == mined(few) != []


def test_rings_leave_out_rows_that_cannot_serve(spark):
    """On rows in clusters most cells are never sent to a group; nothing is lost (see above)."""
    x = np.floor(clustered(4_000, centres=40, spread=0.1) * 256)
    most = float((x * x).sum(1).max())
    lift = lambda p: np.concatenate((p, np.sqrt(most - (p * p).sum(1))[:, None]), 1)
    cells = negatives.Cells(lift(x[:30]), most)
    to, scores = cells.lifted(x), x[:200] @ x.T
    np.fill_diagonal(scores[:, :200], -np.inf)
    fifth = np.sort(scores, 1)[:, -5]
    home = cells.asked(x[:200]).argmin(1)
    sent = needed = 0
    for i in range(200):
        low, high = negatives.rings(cells, x[i : i + 1], home[i : i + 1], fifth[i : i + 1], np.array([np.inf]))
        own = to.argmin(1)
        reach = (low[own] <= to.min(1)) & (to.min(1) <= high[own]) | (own == home[i])
        assert reach[scores[i] >= fifth[i]].all()
        sent, needed = sent + reach.sum(), needed + 4_000
    assert sent < 0.5 * needed


def lloyd(rows, k, rounds, dims):
    """Brute force: {(id, cluster, distance)} sorted, inertia, centroids."""
    good = [(i, np.floor(256 * np.array(x, np.float32).astype(float)).astype(int)) for i, _, x in rows if x is not None and len(x) == dims and all(c is not None and np.isfinite(c) for c in x)]
    order = sorted(good, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1].tolist()))
    at, x = np.array([v for _, v in order[:k]]), np.array([v for _, v in good])
    for r in range(rounds + 1):
        d = ((x[:, None] - at[None]) ** 2).sum(2)
        own = d.argmin(1)
        if r < rounds:
            at = np.array([x[own == c].sum(0) // (own == c).sum() if (own == c).any() else at[c] for c in range(len(at))])
    got = sorted(((i if i is not None else -1), int(c), int(row[c])) for (i, _), c, row in zip(good, own, d, strict=True))
    return got, at


@pytest.mark.parametrize("k", [1, 4, 40])
def test_clusters_match_lloyd(spark, k):
    x = clustered(700, dims=8, seed=k)
    rows = [(i, 0, v.tolist()) for i, v in enumerate(x)]
    rows += [(7, 0, x[7].tolist())] * 2 + [(8, 0, x[9].tolist()), (None, 0, x[5].tolist())] + [(i, 0, x[3].tolist()) for i in range(800, 900)]
    rows += [(900, 0, None), (901, 0, [1.0] * 7), (902, 0, [float("nan")] * 8), (903, 0, [None] * 8), (904, 0, [])]
    out = centroids.cluster(integers.whole(table(spark, rows), "vec_id", dimensions=8), k).collect()
    want, at = lloyd(rows, k, 5, 8)
    assert sorted((-1 if r.vec_id is None else r.vec_id, r.cluster, r.distance) for r in out) == want
    assert {r.inertia for r in out} == {sum(d for *_, d in want)}
    for r in out[:50]:
        assert r.cluster_inertia == sum(d for _, c, d in want if c == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, at[r.cluster])).encode()).hexdigest()


def test_clusters_of_little(spark):
    run_ = lambda rows: centroids.cluster(integers.whole(table(spark, rows), "vec_id", dimensions=2), 3)
    assert run_([]).collect() == [] and ", ".join(f"{f.name} {f.dataType.simpleString()}".replace("bigint", "long") for f in run_([]).schema) == centroids.RESULT
    assert sorted((r.vec_id, r.distance) for r in run_([(1, 0, [1.0, 1.0]), (2, 0, [3.0, 1.0])]).collect()) == [(1, 0), (2, 0)]
    with pytest.raises(PySparkException, match="too long"):
        run_([(1, 0, [1e30, 1.0])]).collect()


def test_bounds_spare_most_scans_and_never_err():
    x = np.floor(256 * clustered(3_000, centres=20, spread=0.2))
    at, before = x[:20].astype(int), None
    cluster, upper, lower = np.full(len(x), -1), np.zeros(len(x)), np.zeros(len(x))
    scans = []
    for _ in range(6):
        cluster, upper, lower, scanned = centroids.settle(x, centroids.Centroids.of(at, before), cluster, upper, lower)
        d = ((x[:, None] - at[None]) ** 2).sum(2)
        assert (cluster == d.argmin(1)).all()
        ordered = np.sqrt(np.sort(d, 1))
        assert (upper >= ordered[:, 0] - 1e-6).all() and (lower <= ordered[:, 1] + 1e-6).all()
        scans.append(scanned.mean())
        before, at = at, np.array([x[cluster == c].astype(int).sum(0) // (cluster == c).sum() if (cluster == c).any() else at[c] for c in range(20)])
    assert scans[0] == 1 and np.mean(scans[1:]) < 0.5
