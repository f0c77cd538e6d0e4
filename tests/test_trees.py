"""Cumulative sums by ranges and folders by intervals, against plain Python and the ancestor joins."""

import random

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import catalog, ordered, trees


def test_sums_before_each_row(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice("ab"), rng.randrange(5)) for i in range(400)] + [(400, None, None)]
    df = spark.createDataFrame(rows, "id long, g string, x int").repartition(5)
    got = {r.id: (r.s, r.n) for r in ordered.before(df, ["x", "id"], {"s": F.coalesce("x", F.lit(0)), "n": F.lit(1)}, 7).collect()}
    want, s = {}, 0
    for n, (i, _, x) in enumerate(sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0, r[0]))):
        want[i], s = (s, n), s + (x or 0)
    assert got == want
    got = {r.id: r.s for r in ordered.before_in_group(df.filter("g = 'a'"), ["g"], ["id"], {"s": F.col("x")}, 7).collect()}
    s = 0
    for i, g, x in rows:
        if g == "a":
            assert got[i] == s
            s += x
    assert ordered.before(df.limit(0), ["id"], {"s": F.col("x")}).collect() == []


def test_packs_hold_about_so_much(spark):
    rng = random.Random(2)
    weights = [rng.choice([0, 1, 5, 90, 1000]) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(weights)), "id long, w long")
    packs = {}
    for r in ordered.packed(df, F.col("w"), 1000, ["id"]).collect():
        packs.setdefault(r.pack, []).append((r.id, r.w))
    assert sum(map(len, packs.values())) == 500
    for rows in packs.values():
        assert sum(w for _, w in rows) < 2000 or len([w for _, w in rows if w]) == 1
    ordered_ids = [i for p in sorted(packs) for i, _ in sorted(packs[p])]
    assert ordered_ids == sorted(ordered_ids)


def random_tree(seed, n=300):
    rng, paths = random.Random(seed), ["/r", "C:\\d", "C:/d"]
    for _ in range(n):
        base = rng.choice(paths)
        paths.append(base + rng.choice("/\\" if base.startswith("C") else "/") + rng.choice(["a", "b", "a b", "a-b", "a.b", "A", "é", "a!", "zz"]))
    return sorted(set(paths))


def below(a, b):
    return b == a or b.startswith(a + "/") or b.startswith(a + "\\")


@pytest.mark.parametrize("seed", [1, 2])
def test_intervals_are_containment(spark, seed):
    paths = random_tree(seed)
    got = {r.path: (r.pre, r.stop, r.n) for r in trees.intervals(spark.createDataFrame([(p, i) for i, p in enumerate(paths)], "path string, i long"), n=F.col("i")).collect()}
    assert set(got) == set(paths)
    for a in paths:
        inside = [b for b in paths if below(a, b)]
        assert {b for b in paths if got[a][0] <= got[b][0] < got[a][1]} == set(inside)
        assert got[a][2] == sum(paths.index(b) for b in inside)


@pytest.mark.parametrize("seed", [3, 4])
def test_same_as_by_ancestors(spark, seed):
    rng, paths = random.Random(seed), random_tree(seed)
    files = [(i, rng.choice(paths), rng.randrange(-5, 100), None, rng.choice(["a", "b", "c", None])) for i in range(500)]
    df = spark.createDataFrame(files, "file_id long, folder_path string, size long, deleted_at long, kind string")
    assert sorted(map(tuple, trees.dominant(df, "kind").collect())) == sorted(map(tuple, catalog.dominant(df, "kind").collect()))
    assert sorted(map(tuple, trees.totals(df).collect())) == sorted(map(tuple, catalog.rollup(df).collect()))
    assert sorted(r.path for r in trees.with_ancestors(df.select(F.col("folder_path").alias("path"))).collect()) == sorted(r.path for r in catalog.folders(df).select("path").collect())
    tree = trees.intervals(trees.with_ancestors(df.select(F.col("folder_path").alias("path"))))
    some = tree.filter(F.xxhash64("path") % 3 != 0)
    assert sorted(map(tuple, trees.enclosing(some).collect()), key=str) == sorted(map(tuple, catalog.nearest_ancestor(some).select("path", "parent_path").collect()), key=str)
    assert sorted(r.path for r in trees.outermost(some).collect()) == sorted(r.path for r in catalog.outermost(some.select("path")).collect())
    folder = paths[len(paths) // 2]
    assert {r.path for r in trees.inside(tree, tree, folder).collect()} == {r.path for r in tree.collect() if below(folder, r.path)}


def test_a_hundred_levels_and_no_levels(spark):
    deep = "".join(f"/d{i}" for i in range(100))
    df = spark.createDataFrame([(1, deep, 5, None), (2, "/d0", 7, None)], "file_id long, folder_path string, size long, deleted_at long")
    got = {r.path: (r.total_files, r.total_bytes) for r in trees.totals(df).collect()}
    assert len(got) == 100 and got["/d0"] == (2, 12) and got[deep] == (1, 5)
    assert trees.totals(df.limit(0)).collect() == []
    known = trees.with_ancestors(df.select(F.col("folder_path").alias("path")))
    plan = trees.intervals(spark.createDataFrame(known.collect(), "path string"), n=F.lit(1))._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan


def test_all_that_contain(spark):
    rng, paths = random.Random(7), random_tree(7)
    tree = trees.intervals(spark.createDataFrame([(p,) for p in paths], "path string"))
    outer, inner = rng.sample(paths, 60) + ["/r"], rng.sample(paths, 80)
    some = lambda names: tree.filter(F.col("path").isin(names))
    got = sorted(map(tuple, trees.containing(some(inner), some(outer)).collect()))
    assert got == sorted((p, a) for p in set(inner) for a in set(outer) if below(a, p))
    assert trees.containing(some([]), some([])).collect() == []


def test_shared_paths_by_either_way(spark):
    from shelfmark.operators import decisions

    rng, paths = random.Random(8), random_tree(8)
    groups = spark.createDataFrame([(f"h{i % 9}", rng.choice(paths)) for i in range(60)] + [("all", "/r")], "hash string, path string")
    findings = spark.createDataFrame([(i, rng.choice(paths), rng.choice(paths)) for i in range(40)] + [(99, "/r", "C:/d")], "id long, subject string, object string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(decisions.shared_paths_by_tree(groups, findings)) == rows(decisions.shared_paths(groups, findings)) != []
