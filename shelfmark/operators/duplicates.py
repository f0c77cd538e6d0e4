"""Duplicate detection: size groups, staged hashes, groups, which copy to keep."""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions import paths
from shelfmark.sources import contents

#: Sampled block and the size limits of the chunk plans.
BLOCK, SMALL, MEDIUM, LARGE = 65_536, 262_144, 1_048_576, 536_870_912
EAGER_FULL = 67_108_864
#: Fixed value: words of places that hold copies.
SUSPECT = r"(?i)\b(backup|old|archive|copy|temp|202\d)\b"


def candidates(files: DataFrame) -> DataFrame:
    """Sizes that more than one live file has."""
    sizes = files.filter("deleted_at IS NULL AND size > 0").groupBy("size").agg(F.count(F.lit(1)).alias("file_count"), F.sum("size").alias("total_bytes"))
    return sizes.filter("file_count > 1")


def hash_jobs(files: DataFrame) -> DataFrame:
    """One job for each live file of a candidate size, larger first."""
    return files.filter("deleted_at IS NULL").join(candidates(files).select("size"), "size", "left_semi").select("file_id", F.lit("sample").alias("job_type"), F.col("size").alias("priority"))


def needs_hash(files: DataFrame) -> DataFrame:
    """Live files of a shared size whose hashes are missing or of another algorithm."""
    stale = F.col("sample_hash").isNull() | (F.col("hash_state") < 2) | F.col("hash_algorithm").isNull() | ~F.col("hash_algorithm").startswith("xxh3-")
    return files.filter("deleted_at IS NULL").filter(stale).join(candidates(files).select("size"), "size", "left_semi")


def chunk_plan(size: Column) -> Column:
    """Offsets and lengths that are sampled of a file of this size (D3)."""
    last = lambda n: F.greatest(F.lit(0), size - n)
    chunk = lambda at: F.struct(at.cast("long").alias("offset"), F.least(F.lit(BLOCK).cast("long"), size - at).cast("long").alias("len"))
    at = lambda part: F.floor((size - BLOCK) * part[0] / part[1])
    zero = F.lit(0).cast("long")
    return (
        F.when(size <= SMALL, F.array(F.struct(zero.alias("offset"), size.cast("long").alias("len"))))
        .when(size <= MEDIUM, F.array(chunk(zero), chunk(last(BLOCK))))
        .when(size <= LARGE, F.array(chunk(zero), chunk(at((1, 2))), chunk(last(BLOCK))))
        .otherwise(F.array(chunk(zero), chunk(at((1, 4))), chunk(at((1, 2))), chunk(at((3, 4))), chunk(last(BLOCK))))
    )


def groups(files: DataFrame) -> DataFrame:
    """Live files equal in size and hashes (A10): members, confidence by the hash level, bytes to win."""
    keys = ["size", "partial_hash", "sample_hash", "full_hash"]
    level = F.when(F.col("full_hash").isNotNull(), 1.0).when(F.col("sample_hash").isNotNull(), 0.8).otherwise(0.6)
    met = files.filter("deleted_at IS NULL AND size > 0 AND partial_hash IS NOT NULL").groupBy(*keys).agg(F.count(F.lit(1)).alias("members"))
    return met.filter("members > 1").select(*keys, "members", level.alias("confidence"), (F.col("size") * (F.col("members") - 1)).alias("reclaimable_bytes"))


def members(found: DataFrame, files: DataFrame) -> DataFrame:
    """Files of each group, by its best hash alone."""
    best = lambda: F.coalesce("full_hash", "sample_hash", "partial_hash")
    level = F.when(F.col("full_hash").isNotNull(), "f").when(F.col("sample_hash").isNotNull(), "s").otherwise("p")
    g = found.select("size", level.alias("level"), best().alias("hash"))
    tagged = [files.filter("deleted_at IS NULL").select("size", F.lit(t).alias("level"), F.col(c).alias("hash"), "file_id", "path", "modified_at") for t, c in (("f", "full_hash"), ("s", "sample_hash"), ("p", "partial_hash"))]
    return g.join(tagged[0].union(tagged[1]).union(tagged[2]).filter("hash IS NOT NULL"), ["size", "level", "hash"])


def sample_paths(found: DataFrame, keep: int = 8) -> DataFrame:
    """The first paths of each group (N1): rows have hash, size and path."""
    order = Window.partitionBy("hash").orderBy(F.desc("size"), "path")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep)


def keep_newest(found: DataFrame) -> DataFrame:
    """Members with the one to keep marked: the newest, the first path on ties (D13). Found by partial minima, not a window."""
    best = found.groupBy("hash").agg(F.min(F.struct(-F.coalesce("modified_at", F.lit(-1)), "path", "file_id")).alias("b")).select("hash", F.col("b.file_id").alias("best"))
    return found.join(best, "hash").withColumn("keep", F.col("file_id") == F.col("best")).drop("best")


def suggest_keep(found: DataFrame) -> DataFrame:
    """Per group the path to keep: not in a suspect place, newest, shallowest."""
    order = Window.partitionBy("hash").orderBy(F.col("path").rlike(SUSPECT), F.desc(F.coalesce("modified_at", F.lit(0))), F.size(F.split("path", r"[/\\]")), "path")
    return found.withColumn("r", F.row_number().over(order)).filter("r = 1").select("hash", F.col("path").alias("keep_path"))


def move_targets(found: DataFrame) -> DataFrame:
    """Per group in several folders, the folder that holds most of it (D15): (hash, target, to_stage), the last how many files lie elsewhere."""
    placed = found.withColumn("folder", paths.parent(F.col("path")))
    by = placed.groupBy("hash", "folder").agg(F.count(F.lit(1)).alias("n"), F.max(F.coalesce("modified_at", F.lit(0))).alias("newest"))
    # By partial minima and sums: a group may lie in very many folders.
    first = F.min(F.struct((-F.col("n")).alias("n"), (-F.col("newest")).alias("newest"), F.size(F.split("folder", r"[/\\]")).alias("depth"), "folder")).alias("best")
    best = by.groupBy("hash").agg(first, F.count(F.lit(1)).alias("folders"), F.sum("n").alias("all"))
    return best.filter("folders > 1").select("hash", F.col("best.folder").alias("target"), (F.col("all") + F.col("best.n")).alias("to_stage"))


def smart_moves(found: DataFrame) -> DataFrame:
    """The files to stage (D15): (hash, file_id, path, destination) of every file of a group that lies outside the group's target folder."""
    placed = found.withColumn("folder", paths.parent(F.col("path")))
    to = placed.join(move_targets(found).select("hash", "target"), "hash").filter("folder <> target")
    return to.select("hash", "file_id", "path", paths.join_destination(F.col("target"), paths.base_name(F.col("path"))).alias("destination"))


def label(confidence: Column) -> Column:
    """Badge of a group's confidence."""
    return F.when(confidence >= 0.99, "VERIFIED").when(confidence >= 0.8, "SAMPLED").otherwise("SIZE MATCH")


def chunk_offsets(size: int) -> list[int]:
    """Offsets of :func:`chunk_plan` for a size over SMALL."""
    ends, inner = [0, size - BLOCK], size - BLOCK
    if size <= MEDIUM:
        return ends
    return [0, *(inner * i // 4 for i in ((2,) if size <= LARGE else (1, 2, 3))), size - BLOCK]


def _chunk_hash(read, size: int, offsets: list[int]) -> str:
    x = xxhash.xxh3_128(size.to_bytes(8, "little"))
    for at in offsets:
        if at < size:
            data = read(at, min(BLOCK, size - at))
            x.update(at.to_bytes(8, "little") + len(data).to_bytes(8, "little") + data)
    return f"{x.intdigest():032x}"


def partial_hash(read, size: int) -> str:
    """Hash of a file's head and tail (D5); an empty file is an error."""
    if not size:
        raise ValueError("empty file")
    return _chunk_hash(read, size, [0, max(0, size - BLOCK)])


#: Bytes that are read ahead while the last ones are hashed.
AHEAD = 8 << 20


def whole_hash(read, size: int) -> str:
    """Hash of all bytes, block by block (D6); of a large file the next bytes are read while the last are hashed."""
    x = xxhash.xxh3_128()
    if size <= AHEAD:
        for at in range(0, size, 2 * BLOCK):
            x.update(read(at, min(2 * BLOCK, size - at)))
        return f"{x.intdigest():032x}"
    with ThreadPoolExecutor(1) as pool:
        coming = pool.submit(read, 0, AHEAD)
        for at in range(0, size, AHEAD):
            data = coming.result()
            if at + AHEAD < size:
                coming = pool.submit(read, at + AHEAD, min(AHEAD, size - at - AHEAD))
            x.update(data)
    return f"{x.intdigest():032x}"


def staged(read, size: int) -> tuple[str, str, str | None, int, str]:
    """Partial, sample and full hash, state and algorithm of a file (D7): small files are hashed whole."""
    if size <= SMALL:
        h = whole_hash(read, size)
        return h, h, h, 4, "xxh3-full-v1"
    return partial_hash(read, size), _chunk_hash(read, size, chunk_offsets(size)), None, 2, "xxh3-sample-v1"


STAGED = "file_id long, partial_hash string, sample_hash string, full_hash string, hash_state int, hash_algorithm string, error string"


def _reader(uri: str):
    """(read, size) of a file that every executor can reach: file, hdfs, s3 or gs."""
    handle = contents.opened(uri)
    return (lambda at, n: handle.read_at(n, at)), handle.size()


def sampled_bytes(size: Column) -> Column:
    """Bytes that the sampling stage reads of a file of this size."""
    return F.aggregate(chunk_plan(size), F.lit(0).cast("long"), lambda a, c: a + c["len"])


def _dealt(files: DataFrame, source: str, weight: Column) -> DataFrame:
    """(file_id, source), dealt to tasks by bytes where sizes are known and contents are to be read."""
    if source == "content" or "size" not in files.columns:
        return files.select("file_id", source)
    return contents.packed(files.select("file_id", source, "size"), F.coalesce(weight, F.lit(0))).select("file_id", source)


def _hashed(rows: pd.DataFrame | dict, source: str, work) -> list[tuple]:
    out = []
    for file_id, value in zip(rows["file_id"], rows[source], strict=True):
        try:
            if value is None:
                raise OSError("no content")
            read, size = ((lambda at, n, v=value: v[at : at + n]), len(value)) if source == "content" else _reader(value)
            out.append((file_id, work(read, size), None))
        except (OSError, ValueError) as e:
            out.append((file_id, None, str(e)))
    return out


def _of_content(files: DataFrame, work, kind: str) -> DataFrame:
    """(file_id, what ``work`` finds, error) of files whose bytes are in ``content``.

    A plain function gets a hundred rows at a time; Arrow would bring ten thousand whole files to a worker at once.
    """

    def run(value: bytes | None) -> tuple:
        return _hashed({"file_id": [None], "content": [value]}, "content", work)[0][1:]

    one = F.udf(run, f"found {kind}, error string", useArrow=False)
    return files.select("file_id", one("content").alias("_h")).select("file_id", F.col("_h.found").alias("found"), F.col("_h.error").alias("error"))


def staged_hashes(files: DataFrame, source: str = "path") -> DataFrame:
    """Sampling stage of files (D4, D5, D7): hashes, state and algorithm, or the error (an issue of the hash phase).

    ``source`` is ``path``, the uri of a file on a shared file system, of which only
    the planned chunks are read, or ``content``, its bytes.
    """
    if source == "content":
        kind = "struct<partial_hash: string, sample_hash: string, full_hash: string, hash_state: int, hash_algorithm: string>"
        found = _of_content(files, staged, kind)
        return found.select("file_id", *[f"found.{c}" for c in ("partial_hash", "sample_hash", "full_hash")], F.coalesce("found.hash_state", F.lit(0)).alias("hash_state"), "found.hash_algorithm", "error")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(i, *(h or (None, None, None, 0, None)), e) for i, h, e in _hashed(part, source, staged)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in STAGED.split(", ")])

    return _dealt(files, source, sampled_bytes(F.col("size"))).mapInPandas(run, STAGED)


def full_hashes(files: DataFrame, source: str = "path") -> DataFrame:
    """XXH3-128 of whole files (D6), or the error."""
    if source == "content":
        return _of_content(files, whole_hash, "string").withColumnRenamed("found", "full_hash")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame(_hashed(part, source, whole_hash), columns=["file_id", "full_hash", "error"])

    return _dealt(files, source, F.col("size")).mapInPandas(run, "file_id long, full_hash string, error string")


def refine(files: DataFrame, mode: str = "smart", source: str = "path") -> tuple[DataFrame, DataFrame]:
    """Files with the hashes of both stages, and the issues of the hash phase.

    Mode ``metadata`` leaves the files as they are. Else files of a shared size
    without valid hashes are sampled, and those that share size and sample are
    hashed in full up to EAGER_FULL bytes.
    """
    none = files.select("file_id", "path", F.lit(None).cast("string").alias("message")).limit(0)
    if mode == "metadata":
        return files, none
    own = ["partial_hash", "sample_hash", "full_hash", "hash_state", "hash_algorithm"]
    first = staged_hashes(needs_hash(files), source)
    good = first.filter("error IS NULL").select("file_id", F.struct(*own).alias("new"))
    sampled = files.join(good, "file_id", "left").select(*[c for c in files.columns if c not in own], *[F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) for c in own])
    second = full_hashes(escalation(sampled), source)
    full = second.filter("error IS NULL").select("file_id", F.col("full_hash").alias("whole"))
    done = sampled.join(full, "file_id", "left").select(
        *[c for c in sampled.columns if c not in own], "partial_hash", "sample_hash", F.coalesce("whole", "full_hash").alias("full_hash"),
        F.when(F.col("whole").isNotNull(), 4).otherwise(F.col("hash_state")).alias("hash_state"), F.when(F.col("whole").isNotNull(), "xxh3-full-v1").otherwise(F.col("hash_algorithm")).alias("hash_algorithm"),
    )
    failed = first.select("file_id", "error").union(second.select("file_id", "error")).filter("error IS NOT NULL")
    return done, failed.join(files.select("file_id", "path"), "file_id").select("file_id", "path", F.col("error").alias("message"))


def escalation(files: DataFrame, most: int = EAGER_FULL) -> DataFrame:
    """Live sampled files, not too large, that share size and sample with another: to be hashed in full."""
    rows = files.filter(f"deleted_at IS NULL AND sample_hash IS NOT NULL AND full_hash IS NULL AND size <= {most}")
    shared = files.filter("deleted_at IS NULL AND sample_hash IS NOT NULL").groupBy("size", "sample_hash").count().filter("count > 1")
    return rows.join(shared, ["size", "sample_hash"], "left_semi")
