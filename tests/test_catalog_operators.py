"""Operators without an oracle: crawls, decisions, layouts, searches."""

import os

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import paths
from shelfmark.functions.intent import intent
from shelfmark.operators import catalog as C
from shelfmark.operators import cleanup as K
from shelfmark.operators import decisions as Y
from shelfmark.operators import facts as KB
from shelfmark.sources import filesystem as S


@pytest.fixture
def tree(tmp_path):
    (tmp_path / "a/b/c").mkdir(parents=True)
    (tmp_path / "a/.hidden").write_bytes(b"12")
    (tmp_path / "a/b/One.TXT").write_bytes(b"123")
    (tmp_path / "a/b/c/two.jpg").write_bytes(b"1234")
    (tmp_path / "a/b/c/same.bin").write_bytes(b"1234")
    os.symlink(tmp_path / "a", tmp_path / "a/loop")
    return tmp_path


def test_crawl(spark, tree):
    events = {(r.kind, os.path.relpath(r.path, tree), r.size) for r in S.crawl(spark, [str(tree)]).collect()}
    assert events == {("folder", ".", None), ("folder", "a", None), ("folder", "a/b", None), ("folder", "a/b/c", None), ("file", "a/.hidden", 2), ("file", "a/b/One.TXT", 3), ("file", "a/b/c/two.jpg", 4), ("file", "a/b/c/same.bin", 4)}
    files, counts = S.scan_to_index(spark, str(tree))
    assert counts == {"files": 4, "folders": 4, "bytes": 13, "errors": 0}
    assert {(r.name, r.extension, r.media_kind) for r in files.collect()} == {(".hidden", None, "other"), ("One.TXT", "txt", "document"), ("two.jpg", "jpg", "photo"), ("same.bin", "bin", "other")}
    assert {(r.name, r.size) for r in S.listed(spark, str(tree)).collect()} >= {("One.TXT", 3), ("two.jpg", 4)}


def test_failures_are_issues_and_are_probed_again(spark, tree):
    gone = str(tree / "a/late")
    events = S.crawl(spark, [str(tree), gone])
    files, issues = S.files_of(events).withColumns({c: F.lit(None).cast("string") for c in C.HASHES} | {"hash_state": F.lit(0)}), S.issues_of(events, 4)
    assert [r.path for r in issues.collect()] == [gone]
    (tree / "a/late").mkdir()
    (tree / "a/late/new.bin").write_bytes(b"9876")
    after, left, counts = S.retry_issues(spark, files, issues, 4)
    rows = {r.name: r for r in after.collect()}
    assert len(rows) == 5 and left.count() == 0 and counts == {"walk": 0, "hash": 0}
    assert rows["new.bin"].full_hash and rows["two.jpg"].full_hash == rows["same.bin"].full_hash != rows["new.bin"].full_hash and rows["One.TXT"].full_hash is None


def test_only_indexes_below_the_folder_are_deleted(spark, tmp_path):
    (tmp_path / "idx/one").mkdir(parents=True)
    assert S.delete_index(spark, str(tmp_path / "idx"), str(tmp_path / "idx/one")) and not (tmp_path / "idx/one").exists()
    for bad in ("idx", "idx/../other", "other"):
        with pytest.raises(ValueError):
            S.delete_index(spark, str(tmp_path / "idx"), str(tmp_path / bad))


def test_decisions(spark):
    rows = [("a", "backupOf-pair", 1, 2, 0.6, "pending"), ("b", "backupOf-pair", 3, 4, 0.65, "pending"), ("c", "near-duplicate-cluster", 5, 6, 0.9, "pending"), ("d", "derivedFrom-pattern", 7, 8, 0.9, "rejected")]
    found = spark.createDataFrame(rows, "id string, kind string, subject_id long, object_id long, confidence double, status string")
    with pytest.raises(ValueError, match="0.7"):
        Y.confirm_kind(found, "backupOf-pair")
    after, facts, relations = Y.confirm_kind(found, "derivedFrom-pattern")
    assert facts.count() == 0 and relations.count() == 0 and after.filter("status = 'confirmed'").count() == 0
    after, facts, relations = Y.confirm(found, found.select("id"))
    assert {(r.subject_id, r.predicate, r.object_id) for r in relations.collect()} == {(1, "backupOf", 2), (3, "backupOf", 4), (5, "nearDuplicateOf", 6), (6, "nearDuplicateOf", 5)}
    assert {(r.entity_id, r.value) for r in facts.collect()} == {(1, "backup"), (3, "backup")}
    none = spark.createDataFrame([], Y.NEGATIVE)
    once = Y.reject_pair(none, 1, "backupOf", 2)
    after, negative = Y.reject(found, found.select("id"), Y.reject_property(once, 9, "role", "scratch"))
    assert sorted((r.subject_id, r.predicate) for r in negative.collect()) == [(1, "backupOf"), (3, "backupOf"), (5, "nearDuplicateOf"), (9, "property")]
    assert {r.status for r in after.collect()} == {"rejected"}
    switch = spark.createDataFrame([], "enabled boolean")
    assert not Y.is_enabled(switch) and Y.is_enabled(Y.set_enabled(switch, True))
    with pytest.raises(ValueError):
        K.draft_log(found, {"id": 1, "status": "executed"}, 0)


def test_regular_expressions_are_those_of_the_engine(spark):
    files = spark.createDataFrame([(1, "ab12", "/x/ab12", 5, 1, None), (2, "zz", "/x/zz", 4, 1, None)], "file_id long, name string, path string, size long, modified_at long, deleted_at long")
    ids = lambda regex: [r.file_id for r in C.search(files, regex=regex).collect()]
    assert ids(r"(?P<n>\d+)$") == [1] and ids("(") == [] and ids(r"\p{Alpha}{2}$") == [2] and ids("[a-z&&[^z]]b") == [1]


def plain_tiles(values, w, h):
    values = sorted(values, key=lambda v: (-v[1], v[0]))
    total, x, y, out = sum(v for _, v in values), 0.0, 0.0, []
    todo = [(n, v / total * w * h) for n, v in values]

    def worst(row, side):
        s = sum(a for _, a in row)
        return max(max(side**2 * a / s**2, s**2 / (side**2 * a)) for _, a in row)

    while todo:
        side, row = min(w, h), [todo[0]]
        while len(row) < len(todo) and worst([*row, todo[len(row)]], side) <= worst(row, side):
            row.append(todo[len(row)])
        thick, at = sum(a for _, a in row) / side, 0.0
        for n, a in row:
            out.append((n, x, y + at, thick, a / thick) if w >= h else (n, x + at, y, a / thick, thick))
            at += a / thick
        x, y, w, h = (x + thick, y, w - thick, h) if w >= h else (x, y + thick, w, h - thick)
        todo = todo[len(row) :]
    return out


def test_squarify_against_plain_loops(spark):
    rows = [("p", f"n{i:03}", (i * 37) % 101 + 1) for i in range(30)] + [("q", "one", 5), ("q", "none", 0)] + [("r", f"m{i:04}", 1) for i in range(500)]
    got = {}
    for r in C.squarify(spark.createDataFrame(rows, "parent_path string, name string, value long")).collect():
        got.setdefault(r.parent_path, {})[r.name] = (r.x, r.y, r.w, r.h)
    for parent in ("p", "q"):
        want = plain_tiles([(n, v) for p, n, v in rows if p == parent and v], 100.0, 100.0)
        assert got[parent].keys() == {n for n, *_ in want}
        assert all(got[parent][n] == pytest.approx(t) for n, *t in want)
    assert len(got["r"]) == 201 and got["r"]["(others)"][2] * got["r"]["(others)"][3] == pytest.approx(6_000)


def test_near_pairs_against_all_pairs(spark):
    import random

    rng = random.Random(4)
    rows = []
    for i in range(120):
        a, b = (rng.getrandbits(64) for _ in range(2))
        for j in range(3):
            x = (a << 64 | b)
            for bit in rng.sample(range(128), rng.choice([0, 1, 5, 7, 12])):
                x ^= 1 << bit
            rows.append((3 * i + j, *(v - (1 << 64) if v >> 63 else v for v in (x >> 64, x & (1 << 64) - 1))))
    want = {(p[0], q[0], d) for p in rows for q in rows if p[0] < q[0] and (d := sum(((u ^ v) & (1 << 64) - 1).bit_count() for u, v in zip(p[1:], q[1:], strict=True))) <= 10}
    got = {tuple(r) for r in KB.near_pairs(spark.createDataFrame(rows, "id long, a long, b long")).collect()}
    assert got == want and len(want) > 100


def test_paths_of_both_kinds(spark):
    rows = spark.createDataFrame([("C:\\a\\b",), ("/a/b",), ("a/b\\c",), ("/",), ("",)], "p string")
    got = {r.p: (r.up, r.parent, r.depth) for r in rows.select("p", paths.ancestors(F.col("p")).alias("up"), paths.parent(F.col("p")).alias("parent"), paths.depth(F.col("p")).alias("depth")).collect()}
    assert got["C:\\a\\b"] == (["C:\\a\\b", "C:\\a", "C:"], "C:\\a", 4) and got["/a/b"] == (["/a/b", "/a"], "/a", 3)
    assert got["a/b\\c"][:2] == (["a/b\\c", "a/b", "a"], "a/b") and got["/"][0] == ["/"] and got[""][0] == []
    found = spark.createDataFrame([("C:\\a",), ("C:/a/b/",), ("D:\\x",)], "path string")
    assert {r.path for r in C.outermost(found).collect()} == {"C:\\a", "D:\\x"}


def test_intent():
    views = ["unclassified", "finished-untouched"]
    assert [intent(t, views) for t in ("", "  Dupes please", "old files", "background.png", "regenerable", "safe to delete?", "unsorted")] == [
        None, ("stage", "duplicates"), ("view", "finished-untouched"), ("search", "background.png"), ("search", "regenerable"), ("stage", "cleanup"), ("view", "unclassified")]


def test_overview_without_sessions(spark):
    issues = spark.createDataFrame([], "id long, scan_id long, phase string, path string")
    sessions = spark.createDataFrame([], "id long, started_at long, inaccessible_entries long")
    assert tuple(C.issue_counts(issues, sessions).first()) == (0, 0)


def test_number_text_at_all_sizes(spark):
    want = {0.5: "0.5", 1.0: "1.0", 0.001: "0.001", 0.000123: "0.000123", 0.0001: "0.0001", 0.00001: "0.00001", 0.000001: "1e-6", 1.25e-7: "1.25e-7", -0.00025: "-0.00025", 12345678.0: "12345678.0", 1e7: "10000000.0", 123456789.125: "123456789.125", 1e15: "1000000000000000.0", 1e16: "1e16", 1.5e300: "1.5e300", 0.0: "0.0", -2.0: "-2.0"}
    rows = spark.createDataFrame([(v,) for v in want], "v double").select("v", paths.number_text(F.col("v")).alias("t")).collect()
    assert {r.v: r.t for r in rows} == want


def test_expressions_with_names(spark):
    files = spark.createDataFrame([(1, "abab.txt", "/r/abab.txt", 5, 1, None), (2, "abba.txt", "/r/abba.txt", 4, 1, None)], "file_id long, name string, path string, size long, modified_at long, deleted_at long")
    ids = lambda r: [x.file_id for x in C.search(files, regex=r).collect()]
    assert ids(r"(?P<two>ab)(?P=two)") == [1] and ids(r"(?P<a>b)b") == [2] and ids("(") == [] and ids("[") == [] and ids("ab") == [1, 2]
