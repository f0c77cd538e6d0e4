"""The decision log, near-duplicate classes and clusters, the icicle by ranges, pages by key, scope children."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfmark.functions.intent import intent
from shelfmark.operators import catalog, facts, hamming
from shelfmark.sources.decision_log import Decision, DecisionLog


def depth_of(df):
    return df._jdf.queryExecution().analyzed().toString().count("\n")


def test_a_thousand_decisions(spark, tmp_path):
    rng = random.Random(8)
    log = DecisionLog(spark, f"file://{tmp_path}/log")
    assert log.negatives().collect() == [] and log.pinned().collect() == [] and not log.is_enabled() and log.compact() == -1
    rejected, pinned, on, decided, depths = {}, {}, False, {}, []
    for batch in range(10):
        events = []
        for i in range(100):
            at = batch * 100 + i
            what = rng.randrange(6)
            s, o = rng.randrange(30), rng.randrange(5)
            if what == 0:
                events.append(Decision("reject", s, "derivedFrom", o, reason=f"r{at}", at=at))
                rejected[s, "derivedFrom", o, None, None] = f"r{at}"
            elif what == 1:
                events.append(Decision("reject", s, key="role", value=f"v{o}", at=at))
                rejected[s, "property", None, "role", f"v{o}"] = None
            elif what == 2:
                events.append(Decision("allow", s, "derivedFrom", o, at=at))
                rejected.pop((s, "derivedFrom", o, None, None), None)
            elif what == 3:
                events.append(Decision("pin", s, reason="p", at=at))
                pinned[s] = at
            elif what == 4:
                events.append(Decision("unpin", s, at=at))
                pinned.pop(s, None)
            else:
                on = bool(o % 2)
                events.append(Decision("enable" if on else "disable", at=at))
                act = rng.choice(["confirm", "dismiss"])
                events.append(Decision(act, discovery_id=f"d{s}", at=at))
                decided.setdefault(f"d{s}", act)
        log.append(events)
        if batch in (0, 9):
            depths.append(depth_of(log.negatives()))
        if batch == 5:
            assert log.compact() == 6 and len(log.batches()) == 1
    assert {(r.subject_id, r.predicate, r.object_id, r.key, r.value): r.reason for r in log.negatives().collect()} == rejected
    assert {r.file_id: r.pinned_at for r in log.pinned().collect()} == pinned and log.is_enabled() == on
    found = spark.createDataFrame([(f"d{i}", "k", "pending" if i % 5 else "rejected") for i in range(40)], "id string, kind string, status string")
    want = {f"d{i}": ("rejected" if i % 5 == 0 else {"confirm": "confirmed", "dismiss": "rejected"}.get(decided.get(f"d{i}"), "pending")) for i in range(40)}
    assert {r.id: r.status for r in log.statuses(found).collect()} == want
    log.decide_kind(found, "k", "confirm", 5_000)
    assert {r.status for r in log.statuses(found).collect()} == {"confirmed", "rejected"}
    assert depths[0] == depths[1]
    assert not log._claim(log.batches()[0], "add")  # a number counts once


def test_equal_hashes_make_rows_and_not_pairs(spark):
    many = spark.range(100_000).select("id", F.lit(7).cast("long").alias("a"), F.lit(9).cast("long").alias("b"))
    assert facts.near_class_pairs(many).count() == 0
    out = facts.near_clusters(many)
    assert out.count() == 100_000 and {tuple(r) for r in out.select("class_id", "cluster_id").distinct().collect()} == {(0, 0)}


def test_classes_expand_to_all_pairs(spark):
    rng = random.Random(9)
    base = [rng.getrandbits(63) for _ in range(6)]
    rows = []
    for i in range(120):
        a, b = rng.choice(base), rng.choice(base[:2])
        for _ in range(rng.choice([0, 0, 1, 3, 9])):
            a ^= 1 << rng.randrange(63)
        rows.append((i, a, b))
    df = spark.createDataFrame(rows, "id long, a long, b long")
    apart = lambda x, y: bin((x[1] ^ y[1]) & (2**64 - 1)).count("1") + bin((x[2] ^ y[2]) & (2**64 - 1)).count("1")
    want = {(x[0], y[0], apart(x, y)) for x in rows for y in rows if x[0] < y[0] and apart(x, y) <= 10}
    assert {tuple(r) for r in facts.near_pairs(df).collect()} == want
    cluster = {r.id: r.cluster_id for r in facts.near_clusters(df).collect()}
    least = {i: i for i in range(120)}
    for _ in range(120):
        for x, y, _ in want:
            least[x] = least[y] = min(least[x], least[y])
    assert cluster == least
    member = {r.id: r.class_id for r in facts.near_classes(df).collect()}
    pairs = {(r.left_id, r.right_id): r.distance for r in facts.near_class_pairs(df).collect()}
    assert {(x, y, d) for x, y, d in want if d} == {(x, y, d) for x in range(120) for y in range(x + 1, 120) if (d := pairs.get(tuple(sorted((member[x], member[y])))))}


def test_icicle_of_one_wide_folder(spark):
    rows = [("/r", None, "r", 0, 0)] + [(f"/r/{i:05}", "/r", str(i), 1, (i * 7919) % 1000) for i in range(20_000)]
    total = sum(r[4] for r in rows)
    tree = spark.createDataFrame([(*rows[0][:4], total), *rows[1:]], "path string, parent_path string, name string, depth int, bytes long")
    got = {r.path: (r.x, r.w) for r in catalog.icicle(tree, float(total)).collect()}
    at = 0
    for path, _, _, _, b in sorted((r for r in rows[1:] if r[4]), key=lambda r: (-r[4], r[0])):
        assert got[path] == (pytest.approx(at), pytest.approx(b))
        at += b
    plan = catalog.icicle(tree)._jdf.queryExecution().executedPlan().toString()
    assert "Window [" not in plan or "parent_path" not in plan.split("Window [")[1][:200]


def test_pages_join_to_the_whole_list(spark):
    rng = random.Random(10)
    rows = [(i, rng.choice([None, 1, 2, 3]), rng.choice(["a", "b", None])) for i in range(97)]
    df = spark.createDataFrame(rows, "id long, x int, s string").repartition(4)
    order = [("x", "desc"), ("s", "asc"), ("id", "asc")]
    whole = [r.id for r in df.orderBy(F.desc_nulls_last("x"), F.asc_nulls_last("s"), "id").collect()]
    got, after = [], None
    while part := catalog.page(df, order, 10, after).collect():
        got += [r.id for r in part]
        after = part[-1].asDict()
    assert got == whole


def test_a_page_is_a_pushed_filter_and_a_top(spark, tmp_path):
    spark.range(1_000).select("id", (F.col("id") % 50).alias("size")).write.parquet(str(tmp_path / "t"))
    plan = catalog.page(spark.read.parquet(str(tmp_path / "t")), [("size", "desc"), ("id", "asc")], 5, {"size": 7, "id": 107})._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "LessThanOrEqual(size,7)" in plan and "Window" not in plan


def test_scope_children(spark):
    rows = [("/a", 9, 90), ("/a/b", 4, 50), ("/a/b/c/d", 1, 10), ("/a/e", 2, 60), ("/z", 1, 5), ("C:\\k", 1, 7), ("C:\\k\\m", 1, 3)]
    df = spark.createDataFrame(rows, "path string, total_files long, total_bytes long")
    names = lambda scope: [(r.path, r["name"], r.has_children) for r in catalog.scope_children(df, scope).collect()]
    assert names("/a") == [("/a/e", "e", False), ("/a/b", "b", True)]
    assert names(None) == names("/none") == [("/a", "a", True), ("C:\\k", "k", True), ("/z", "z", False)]
    assert names("/a/b") == [("/a/b/c/d", "d", False)] and names("C:\\k") == [("C:\\k\\m", "m", False)] and names("/z") == []


def test_lines_that_ask():
    views = ["regenerable-large", "unclassified", "finished-untouched"]
    want = {
        "free  space": ("search", "free  space"), "please clean up!": ("stage", "cleanup"), "no role": ("view", "unclassified"), "old duplicates": ("stage", "duplicates"), "gold": ("search", "gold"), "lone backups": ("search", "lone backups"),
        "(map)": ("stage", "treemap"), "my_map": ("search", "my_map"), "Stale, old": ("view", "finished-untouched"), "\tregen\n": ("view", "regenerable-large"), "large files": ("stage", "files"), "large-files": ("search", "large-files"), "???": ("search", "???"),
    }
    assert {line: intent(line, views) for line in want} == want and intent(" \n", views) is None


def test_wide_distances_are_compared_by_chunks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    monkeypatch.setattr(hamming, "LEAST", 100)
    monkeypatch.setattr(hamming, "BLOCK_WORDS", 500)
    for bits, most in ((62, 18), (128, 44)):
        a = rng.integers(-(2**63), 2**63 - 1, 300) if bits > 64 else rng.integers(0, 2**62, 300)
        b = rng.integers(-(2**63), 2**63 - 1, 300) if bits > 64 else np.zeros(300, np.int64)
        rows = [(int(i), int(x), int(y)) for i, (x, y) in enumerate(zip(a, b, strict=True))]
        df = spark.createDataFrame([(i + 1000, x, y) for i, x, y in rows[:20]] + rows, "id long, a long, b long")
        found = facts.near_class_pairs(df, most, bits)
        assert "MapInArrow" in found._jdf.queryExecution().toString()
        apart = lambda p, q: ((p[1] ^ q[1]) & (2**64 - 1)).bit_count() + ((p[2] ^ q[2]) & (2**64 - 1)).bit_count()
        want = sorted((p[0], q[0], d) for p in rows for q in rows if p[0] < q[0] and (d := apart(p, q)) <= most)
        assert want and sorted(tuple(r) for r in found.collect()) == want
    assert facts.near_class_pairs(df.limit(0), 18, 62).count() == 0


def test_links_of_clusters_follow_the_hashes(spark):
    df = spark.range(2048).select("id", F.col("id").alias("a"), F.lit(0).cast("long").alias("b"))  # all are 11 bits apart at most
    links = facts.near_class_links(df, 18, 62).count()
    assert 2047 <= links <= 2 * 2048 * 3  # three meetings of two chunks, not 2 million pairs
    assert facts.near_clusters(df, 18, 62).select("cluster_id").distinct().collect() == [(0,)]
