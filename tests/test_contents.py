"""Hashes, extracted facts and image hashes on bytes."""

import random

import xxhash
from pyspark.sql import functions as F

from shelfmark.operators import duplicates as D
from shelfmark.operators import extract as X


def chunk_hash(data, offsets):
    """Size, then offset, length and bytes of each chunk, all numbers as 8 little-endian bytes."""
    text = len(data).to_bytes(8, "little")
    for at in offsets:
        block = data[at : at + 65_536]
        text += at.to_bytes(8, "little") + len(block).to_bytes(8, "little") + block
    return xxhash.xxh3_128(text).hexdigest()


def test_chunk_plan_of_large_sizes(spark):
    sizes = [0, 1, 262_144, 262_145, 1_048_576, 1_048_577, 536_870_912, 536_870_913, 600 << 20, (600 << 20) + 3, 7 << 30]
    rows = spark.createDataFrame([(s,) for s in sizes], "size long").select("size", D.chunk_plan(F.col("size")).alias("p")).collect()
    for size, plan in rows:
        last, mid = size - 65_536, lambda f, s=size: (s - 65_536) * f // 4
        want = [0] if size <= 262_144 else [0, last] if size <= 1 << 20 else [0, mid(2), last] if size <= 512 << 20 else [0, mid(1), mid(2), mid(3), last]
        assert [c.offset for c in plan] == want and (size <= 262_144 or D.chunk_offsets(size) == want)


def test_staged_hashes_of_files_and_contents(spark, tmp_path):
    rng = random.Random(1)
    data = {i: rng.randbytes(n) for i, n in enumerate([1, 200_000, 262_144, 300_000, 1_048_576, 3_000_001])} | {8: b""}
    for i, d in data.items():
        (tmp_path / f"f{i}").write_bytes(d)
    rows = [(i, str(tmp_path / f"f{i}"), bytearray(d)) for i, d in data.items()] + [(9, str(tmp_path / "gone"), None)]
    files = spark.createDataFrame(rows, "file_id long, path string, content binary")
    for source in ("path", "content"):
        out = {r.file_id: r for r in D.staged_hashes(files, source).collect()}
        assert out[9].error and out[9].hash_state == 0 and out[9].full_hash is None
        assert out[8].full_hash == xxhash.xxh3_128(b"").hexdigest()
        for i, d in data.items():
            if len(d) <= 262_144:
                whole = xxhash.xxh3_128(d).hexdigest()
                assert (out[i].partial_hash, out[i].sample_hash, out[i].full_hash, out[i].hash_state, out[i].hash_algorithm) == (whole, whole, whole, 4, "xxh3-full-v1")
            else:
                last = len(d) - 65_536
                points = [0, last] if len(d) <= 1 << 20 else [0, last // 2, last]
                assert (out[i].partial_hash, out[i].sample_hash) == (chunk_hash(d, [0, last]), chunk_hash(d, points)) and out[i].full_hash is None and out[i].hash_state == 2
    full = {r.file_id: r.full_hash for r in D.full_hashes(files).collect()}
    assert all(full[i] == xxhash.xxh3_128(d).hexdigest() for i, d in data.items()) and full[9] is None


def test_large_sparse_file(spark, tmp_path):
    size = (513 << 20) + 5
    with open(tmp_path / "big", "wb") as f:
        f.seek((size - 65_536) // 4)
        f.write(b"quarter")
        f.truncate(size)
    with open(tmp_path / "big", "rb") as f:
        text = size.to_bytes(8, "little")
        for i in range(5):
            at = (size - 65_536) * i // 4
            f.seek(at)
            block = f.read(65_536)
            text += at.to_bytes(8, "little") + len(block).to_bytes(8, "little") + block
    out = D.staged_hashes(spark.createDataFrame([(1, f"file://{tmp_path}/big")], "file_id long, path string")).first()
    assert out.sample_hash == xxhash.xxh3_128(text).hexdigest()


def test_refine_hashes_in_two_stages(spark):
    rng = random.Random(2)
    one, two = rng.randbytes(400_000), bytearray(rng.randbytes(400_000))
    other = bytearray(one)
    other[200_000] ^= 1  # outside the sampled chunks
    rows = [(i, f"/f{i}", bytearray(d), len(d)) for i, d in enumerate([one, one, other, two, b"alone"])]
    files = spark.createDataFrame(rows, "file_id long, path string, content binary, size long")
    files = files.withColumns({c: F.lit(None).cast("string") for c in X_HASHES} | {"hash_state": F.lit(0), "deleted_at": F.lit(None).cast("long")})
    done, failed = D.refine(files, source="content")
    out = {r.file_id: r for r in done.collect()}
    assert out[0].sample_hash == out[2].sample_hash and out[0].full_hash == out[1].full_hash != out[2].full_hash
    assert out[3].full_hash is None and out[3].hash_state == 2 and out[4].hash_state == 0 and failed.count() == 0
    assert D.refine(files, "metadata")[0] is files


X_HASHES = ("partial_hash", "sample_hash", "full_hash", "hash_algorithm")


def frame(name, text, encoding, syncsafe=True):
    body = bytes([encoding]) + text
    n = len(body)
    size = bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127]) if syncsafe else n.to_bytes(4, "big")
    return name + size + b"\0\0" + body


def id3(*frames):
    body = b"".join(frames) + b"\0" * 10
    n = len(body)
    return b"ID3\x03\0\0" + bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127]) + body


def test_extracted_facts(spark):
    end = lambda n: b"PK\x05\x06" + b"\0" * 6 + n.to_bytes(2, "little") + b"\0" * 10
    contents = {
        "pdf": [(b"%PDF /Title (A \\(b\\) c\\n d) /Title (z)", {("title", "A (b) c\n d")}), (b"/Title no", set()), (b"/Title (\0 )", set()), (b"/Title (open", {("title", "open")})],
        "JPG": [(b"\xff\xd8 2020:1:1 2021:02:03 04:05:06 2022:02:03 04:05:06", {("capturedAt", "2021:02:03 04:05:06")}), (b"2021:02:03 04:05:06", set())],
        "zip": [(b"x" + end(3) + end(258), {("archiveEntryCount", "258"), ("origin", "archive-extracted")}), (end(3)[:-1], set())],
        "mp3": [
            (id3(frame(b"TIT2", b"Song", 0), frame(b"TPE1", "Bänd".encode(), 3), frame(b"TALB", b"\xff\xfe" + "Älbum".encode("utf-16-le"), 1), frame(b"TXXX", b"no", 0)), {("title", "Song"), ("artist", "Bänd"), ("album", "Älbum")}),
            (id3(frame(b"TIT2", b"x" * 199, 0, syncsafe=False)), {("title", "x" * 199)}), (id3(frame(b"TIT2", b"x", 9)), set()), (b"ID3", set()),
        ],
        "txt": [(b"/Title (no)", set())],
    }
    rows, want, i = [], {}, 0
    for kind, cases in contents.items():
        for data, facts in cases:
            rows.append((i, kind, bytearray(data)))
            want[i], i = facts, i + 1
    rows.append((i, "pdf", None))
    found = X.extracted_facts(spark.createDataFrame(rows, "file_id long, extension string, content binary"))
    got = {}
    for r in found.collect():
        got.setdefault(r.entity_id, set()).add((r.key, r.value))
    assert got == {k: v for k, v in want.items() if v}


def plain_hashes(data):
    def means(k):
        out = []
        for i in range(k):
            a = i * len(data) // k
            b = min(max((i + 1) * len(data) // k, a + 1), len(data))
            out.append(sum(data[a:b]) // (b - a))
        return out

    m, n = means(64), means(65)
    pack = lambda bits: int.from_bytes(sum(1 << i for i, b in enumerate(bits) if b).to_bytes(8, "little"), "little", signed=True)
    return pack([x >= sum(m) // 64 for x in m]), pack([n[i + 1] >= n[i] for i in range(64)])


def test_image_hashes(spark):
    rng = random.Random(3)
    data = {i: rng.randbytes(n) for i, n in enumerate([1, 5, 63, 64, 65, 1000, 100_000])}
    rows = [(i, "Png", bytearray(d)) for i, d in data.items()] + [(90, "jpg", bytearray()), (91, "gif", None), (92, "txt", bytearray(b"x")), (93, None, bytearray(b"x"))]
    got = {r.id: (r.a, r.b) for r in X.image_hashes(spark.createDataFrame(rows, "file_id long, extension string, content binary")).collect()}
    assert got == {i: plain_hashes(d) for i, d in data.items()}


def test_contents_go_to_python_row_by_row(spark):
    data = [(1, b"a" * 10), (2, b"b" * (3 << 20)), (3, None), (4, b"")]
    files = spark.createDataFrame(data, "file_id long, content binary")
    of = lambda b: D.whole_hash(lambda at, n: b[at : at + n], len(b))
    full = D.full_hashes(files, "content")
    staged = D.staged_hashes(files, "content")
    for df in (full, staged):  # Arrow would bring ten thousand whole files to a worker at once
        plan = df._jdf.queryExecution().toString()
        assert "BatchEvalPython" in plan and "MapInPandas" not in plan
    assert [c.split()[0] for c in D.STAGED.split(", ")] == staged.columns
    want = {i: (None if b is None else of(b), "no content" if b is None else None) for i, b in data}
    assert {r.file_id: (r.full_hash, r.error) for r in full.collect()} == want
    assert {r.file_id: (r.full_hash, r.hash_state, r.error) for r in staged.collect()} == {1: (of(b"a" * 10), 4, None), 2: (None, 2, None), 3: (None, 0, "no content"), 4: (of(b""), 4, None)}
