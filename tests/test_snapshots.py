"""Versioned snapshots by buckets, and totals kept up by what changed."""

import os
import random

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import catalog, deltas
from shelfmark.sources import snapshots

SCHEMA = "path string, folder_path string, name string, extension string, size long, modified_at long, created_at long"


def row(folder, name, size, at=1):
    return (f"{folder}/{name}", folder, name, name.rsplit(".", 1)[1] if "." in name else None, size, at, at)


def table(spark, rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def live(df):
    return sorted((r.path, r.size) for r in catalog.live(df).collect())


def test_a_scan_of_one_folder_rewrites_its_bucket_only(spark, tmp_path):
    store = snapshots.Snapshots(spark, f"file://{tmp_path}/t", 64)
    assert store.read() is None and store.numbers() == []
    first = [row(f"/r/f{i}", f"x{j}.txt", i + j) for i in range(30) for j in range(3)]
    v0 = store.scan(table(spark, first), "/r", 100)
    assert v0.number == 0 and live(store.read()) == sorted((r[0], r[4]) for r in first)
    second = [row("/r/f7", "x0.txt", 999, 2), row("/r/f7", "new.md", 5), row("/r/f7", "x2.txt", 9)]  # x1 is gone, x2 as it was
    v1 = store.scan(table(spark, second), "/r/f7", 200)
    assert v1.note["touched"] == 1 and [b for b in v1.buckets if v1.buckets[b] == 1] == [b for b in v1.buckets if v1.buckets[b] != v0.buckets.get(b)]
    assert os.listdir(tmp_path / "t" / "data" / "v=1") and sum(d.startswith("bucket=") for d in os.listdir(tmp_path / "t" / "data" / "v=1")) == 1
    want = {r[0]: r[4] for r in first} | {r[0]: r[4] for r in second}
    del want["/r/f7/x1.txt"]
    assert live(store.read()) == sorted(want.items())
    assert live(store.read(0)) == sorted((r[0], r[4]) for r in first)
    gone = store.read().filter("deleted_at IS NOT NULL").collect()
    assert [(r.path, r.deleted_at) for r in gone] == [("/r/f7/x1.txt", 200)]
    assert sorted(r.path for r in store.folder("/r/f7", 0).collect()) == [f"/r/f7/x{j}.txt" for j in range(3)]
    assert sorted(r.path for r in store.changes(0, 1).collect()) == ["/r/f7/new.md", "/r/f7/x0.txt", "/r/f7/x1.txt"]


def test_a_killed_write_leaves_the_old_version(spark, tmp_path, monkeypatch):
    store = snapshots.Snapshots(spark, f"file://{tmp_path}/t", 8)
    store.scan(table(spark, [row("/a", "1.txt", 1)]), "/a", 1)
    with monkeypatch.context() as m:
        m.setattr(store, "_commit", lambda version: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            store.scan(table(spark, [row("/a", "1.txt", 50, 2)]), "/a", 2)
    assert store.numbers() == [0] and live(store.read()) == [("/a/1.txt", 1)]
    store.scan(table(spark, [row("/a", "1.txt", 60, 3)]), "/a", 3)
    assert live(store.read()) == [("/a/1.txt", 60)]
    with pytest.raises(snapshots.Conflict):
        store._commit(snapshots.Version(1))
    # A scan that finds nothing marks all as deleted; a later one revives.
    store.scan(table(spark, []), "/a", 4)
    assert live(store.read()) == []
    store.scan(table(spark, [row("/a", "1.txt", 60, 3)]), "/a", 5)
    assert live(store.read()) == [("/a/1.txt", 60)]
    assert store.vacuum(2) == 2 and store.numbers() == [2, 3] and live(store.read()) == [("/a/1.txt", 60)] and live(store.read(2)) == []
    with pytest.raises(KeyError):
        store.read(0)


def test_totals_after_twenty_random_changes(spark, tmp_path):
    rng = random.Random(5)
    store = snapshots.Snapshots(spark, f"file://{tmp_path}/t", 16)
    folders = [f"/r/{a}/{b}" for a in "abc" for b in "xyz"] + ["/r", "/r/a"]
    files = {f"{f}/{i}": row(f, f"{i}.{rng.choice(['txt', 'jpg', 'rs'])}", rng.randrange(100)) for f in folders for i in range(4)}
    store.scan(table(spark, files.values()), "/r", 1)
    full = lambda: catalog.live(store.read())
    totals, direct, sums = catalog.rollup(full()), catalog.folder_records(full()), deltas.value_sums(full())
    for step in range(4):
        for _ in range(5):
            k = rng.choice(list(files))
            what = rng.randrange(3)
            if what == 0:
                del files[k]
            elif what == 1:
                files[k] = (*files[k][:4], rng.randrange(100), step + 2, 1)
            else:
                f = rng.choice([*folders, "/r/new/deep"])
                r = row(f, f"n{rng.randrange(10**6)}.md", rng.randrange(100))
                files[r[0]] = r
        version = store.scan(table(spark, files.values()), "/r", 10 + step)
        changed = store.changes(version.number - 1, version.number)
        totals, direct, sums = deltas.totals(totals, changed), deltas.direct_totals(direct, changed), deltas.changed_value_sums(sums, changed)
        # As a job would, keep what was added up.
        totals, direct, sums = (spark.createDataFrame(x.collect(), x.schema) for x in (totals, direct, sums))
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(totals) == rows(catalog.rollup(full())) and rows(direct) == rows(catalog.folder_records(full()))
    assert rows(sums) == rows(deltas.value_sums(full())) and rows(deltas.dominant(sums)) == rows(catalog.dominant(full(), "extension"))
    reached = deltas.folder_changes(store.changes(3, 4).filter(F.col("path") == F.lit("none")))
    assert reached.collect() == []
