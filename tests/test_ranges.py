"""Bytes of files by ranges, work packed by bytes, and the crawl by budget, on files of a folder."""

import os
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from shelfmark.operators import duplicates as D
from shelfmark.operators import extract as X
from shelfmark.sources import contents, filesystem

PDF = b"%PDF-1.4\n1 0 obj << /Title (Annual \\(final\\) report) >>\n"
JPEG = b"\xff\xd8\xff\xe1..Exif..2021:05:06 07:08:09.."
ZIP = b"PK\x03\x04" + b"x" * 50 + b"PK\x05\x06" + bytes(6) + (3).to_bytes(2, "little") + bytes(10)


@pytest.fixture
def folder(tmp_path):
    rng = random.Random(4)
    data = {"a.pdf": PDF, "b.jpg": JPEG + rng.randbytes(5_000), "c.zip": ZIP, "d/e.bin": rng.randbytes(400_000), "d/f.bin": b"", "d/g.png": rng.randbytes(999)}
    for name, d in data.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(d)
    with open(tmp_path / "sparse.pdf", "wb") as f:
        f.write(PDF)
        f.truncate(1 << 30)
    return tmp_path, data | {"sparse.pdf": PDF + bytes((2 << 20) - len(PDF))}


def listed(spark, root):
    files, n = filesystem.scan_to_index(spark, str(root))
    assert n["errors"] == 0
    return files.withColumn("file_id", F.xxhash64("path"))


def test_heads_facts_and_hashes_of_files(spark, folder):
    root, data = folder
    files = listed(spark, root)
    got = {os.path.relpath(r.path, root): (bytes(r.content), r.error) for r in contents.heads(files, X.HEAD).collect()}
    assert got == {name: (d, None) for name, d in data.items()}  # of the sparse file 2 MiB
    facts = X.extracted_facts(contents.heads(files, X.HEAD)).join(files.select(F.col("file_id").alias("entity_id"), "name"), "entity_id")
    assert {(r["name"], r.key, r.value) for r in facts.collect()} == {
        ("a.pdf", "title", "Annual (final) report"), ("sparse.pdf", "title", "Annual (final) report"), ("b.jpg", "capturedAt", "2021:05:06 07:08:09"), ("c.zip", "archiveEntryCount", "3"), ("c.zip", "origin", "archive-extracted"),
    }
    hashes = X.image_hashes(contents.heads(files, X.IMAGE_HEAD)).join(files.select(F.col("file_id").alias("id"), "name"), "id").collect()
    assert {(r["name"], r.a, r.b) for r in hashes} == {(n, X.average_hash(data[n]), X.difference_hash(data[n])) for n in ("b.jpg", "d/g.png")} or {r["name"] for r in hashes} == {"b.jpg", "g.png"}
    for r in hashes:
        d = data["b.jpg" if r["name"] == "b.jpg" else "d/g.png"]
        assert (r.a, r.b) == (X.average_hash(d), X.difference_hash(d))


def test_chunks_are_what_the_plan_says(spark, folder):
    root, data = folder
    files = listed(spark, root)
    got = contents.chunks(files.filter("name = 'e.bin'"), D.chunk_plan(F.col("size"))).orderBy("offset").collect()
    d = data["d/e.bin"]
    assert [(r.offset, bytes(r.content)) for r in got] == [(0, d[:65_536]), (400_000 - 65_536, d[-65_536:])]
    big = contents.chunks(files.filter("name = 'sparse.pdf'"), D.chunk_plan(F.col("size"))).collect()
    assert sum(len(r.content) for r in big) == 5 * 65_536
    odd = spark.createDataFrame([(1, str(root / "gone"), 0, 5), (2, None, 0, 5), (3, str(root / "a.pdf"), 10_000, 5), (4, str(root / "a.pdf"), 3, -1)], "file_id long, path string, offset long, length long")
    out = {r.file_id: r for r in contents.read_ranges(odd).collect()}
    assert out[1].content is None and out[1].error and out[2].error and bytes(out[3].content) == b"" and bytes(out[4].content) == PDF[3:]


def test_hashes_of_files_dealt_by_bytes(spark, folder):
    root, data = folder
    files = listed(spark, root).filter("name <> 'sparse.pdf'")
    want = {name: xxhash.xxh3_128(d).hexdigest() for name, d in data.items()}
    names = {r.file_id: os.path.relpath(r.path, root) for r in files.select("file_id", "path").collect()}
    assert all(r.full_hash == want[names[r.file_id]] for r in D.full_hashes(files).collect())
    staged = {names[r.file_id]: r for r in D.staged_hashes(files).collect()}
    assert staged["a.pdf"].full_hash == want["a.pdf"] and staged["d/e.bin"].full_hash is None and staged["d/e.bin"].hash_state == 2
    long = random.Random(5).randbytes((17 << 20) + 3)  # read ahead block by block
    assert D.whole_hash(lambda at, n: long[at : at + n], len(long)) == xxhash.xxh3_128(long).hexdigest()


def test_tasks_get_about_as_many_bytes(spark):
    rng = random.Random(6)
    sizes = [rng.choice([10, 1_000, 100_000, 3_000_000]) for _ in range(3_000)]
    files = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "file_id long, size long")
    dealt = contents.packed(files, F.col("size"), 16 << 20).withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.sum(F.col("size") + contents.PER_FILE).alias("n")).collect()
    loads = sorted(r.n for r in dealt)[1:]  # the last pack may be small
    assert len(loads) > 30 and max(loads) <= 2 * min(loads)


def test_the_data_source(spark, folder):
    root, data = folder
    spark.dataSource.register(contents.FileRanges)
    read = spark.read.format("file_ranges").option("path", str(root)).option("offset", 4).option("length", 100)
    got = {os.path.relpath(r.path, root): (bytes(r.content), r.size) for r in read.load().collect()}
    assert got == {n: (d[4:104], (1 << 30) if n == "sparse.pdf" else len(d)) for n, d in data.items()}
    narrow = read.schema("path string, size long").load().collect()
    assert {(os.path.relpath(r.path, root), r.size) for r in narrow} == {(n, s) for n, (_, s) in got.items()}
    small = spark.read.format("file_ranges").option("path", str(root / "d")).option("taskBytes", 400_000).load()
    assert small.rdd.getNumPartitions() >= 2 and {bytes(r.content) for r in small.collect()} == {data["d/e.bin"], data["d/f.bin"], data["d/g.png"]}


def test_crawl_follows_work_and_not_depth(spark, tmp_path, monkeypatch):
    at = tmp_path / "chain"
    at.mkdir()
    # Names of one letter keep a path of 500 folders within what the system takes.
    for i in range(500):
        at = at / "d"
        at.mkdir()
        if i % 50 == 0:
            (at / "f.txt").write_bytes(b"x" * i)
    for i in range(40):
        (tmp_path / "wide" / str(i)).mkdir(parents=True)
        for j in range(6):
            (tmp_path / "wide" / str(i) / f"{j}.rs").write_bytes(b"y")
    jobs = []
    written = filesystem.shared.written
    monkeypatch.setattr(filesystem.shared, "written", lambda df, tag: jobs.append(tag) or written(df, tag))
    deep = filesystem.crawl(spark, [str(tmp_path / "chain")])
    assert len(jobs) == 1 and deep.filter("kind = 'folder'").count() == 501 and deep.filter("kind = 'file'").count() == 10
    for budget in (7, 50, 10_000):
        got = sorted((r.kind, r.path, r.size) for r in filesystem.crawl(spark, [str(tmp_path / "wide")], budget).collect())
        want = [("folder", d, None) for d, _, _ in os.walk(tmp_path / "wide")] + [("file", os.path.join(d, f), 1) for d, _, fs in os.walk(tmp_path / "wide") for f in fs]
        assert got == sorted(want)
    assert {r.created_at for r in filesystem.files_of(deep).collect()} == {None} or hasattr(os.stat(tmp_path), "st_birthtime")


def test_issues_are_capped(spark):
    issues = spark.createDataFrame([(1, "walk", f"/p{i:04}", "m") for i in range(700)] + [(1, "hash", "/h", "m"), (2, "walk", "/q", "m")], "scan_id long, phase string, path string, message string")
    kept = filesystem.capped(issues, 1).collect()
    assert len([r for r in kept if r.scan_id == 1]) == 500 and len([r for r in kept if r.scan_id == 2]) == 1
    files = spark.createDataFrame([], filesystem.records(spark.createDataFrame([("/a", 1, 1, 1, 1)], "path string, size long, modified_at long, accessed_at long, created_at long")).schema)
    for c in (*filesystem.catalog.HASHES, "hash_state"):
        files = files.withColumn(c, F.lit(None).cast("int" if c == "hash_state" else "string"))
    _, after = filesystem.probe(spark, files, issues, 1)
    assert after.filter("scan_id = 1").count() <= 500


def test_files_to_stage(spark):
    rows = [(1, "/a/x", "h", 5), (2, "/a/y", "h", 5), (3, "/b/z", "h", 9), (4, "C:\\k\\q", "h", 1), (5, "/a/o", "i", 1), (6, "/a/p", "i", 1), (7, "C:\\m\\n\\u", "j", 1), (8, "C:\\m\\v", "j", 1)]
    df = spark.createDataFrame(rows, "file_id long, path string, hash string, modified_at long")
    assert {(r.hash, r.target, r.to_stage) for r in D.move_targets(df).collect()} == {("h", "/a", 2), ("j", "C:\\m", 1)}
    assert {(r.file_id, r.destination) for r in D.smart_moves(df).collect()} == {(3, "/a/z"), (4, "/a/q"), (7, "C:\\m\\u")}
    assert {r.hash: r.keep_path for r in D.suggest_keep(df).collect()}["j"] == "C:\\m\\v"
