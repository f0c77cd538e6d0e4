"""File trees as catalog tables: a crawl by work budget, and re-probing of what failed.

A crawl starts with the roots. A task walks its folders depth first until it has listed
as many entries as its budget allows; folders still open are returned and dealt out anew, so rounds follow the
size of the tree and not its depth, and a deep chain is one task's walk. Folders must lie on
a file system that every executor mounts (for object stores use
:func:`listed`). Each round is written before the next, so a lost executor costs a
round, not the crawl. The driver sees counts.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import paths
from shelfmark.operators import catalog
from shelfmark.sources import shared

EVENT = "kind string, path string, folder_path string, name string, size long, modified_at long, accessed_at long, created_at long, message string"
WORKERS = (2, 32)
#: Entries that a task lists, in the first round and later, and open folders of a later task.
FIRST_BUDGET, BUDGET, FOLDERS_A_TASK = 5_000, 100_000, 100


def _born(info: os.stat_result) -> int | None:
    """Birth time, where the system tells it; a change of the inode is no birth."""
    born = getattr(info, "st_birthtime", None)
    return None if born is None else int(born)


def _entries(folder: str) -> Iterator[tuple]:
    """Events of one folder: its files and folders (symlinks are skipped), an error for what can't be read."""
    try:
        with os.scandir(folder) as found:
            entries = list(found)
    except OSError as e:
        yield ("error", folder, None, None, None, None, None, None, str(e))
        return
    for entry in entries:
        try:
            info = entry.stat(follow_symlinks=False)
        except OSError as e:
            yield ("error", entry.path, folder, None, None, None, None, None, str(e))
            continue
        if stat.S_ISDIR(info.st_mode):
            yield ("folder", entry.path, folder, entry.name, None, None, None, None, None)
        elif stat.S_ISREG(info.st_mode):
            yield ("file", entry.path, folder, entry.name, info.st_size, int(info.st_mtime), int(info.st_atime), _born(info), None)


def _explorer(budget: int):
    """A task: events below its folders until ``budget`` entries are listed, then its open folders (kind ``open``)."""
    names = [c.split()[0] for c in EVENT.split(", ")]

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=names).astype({c: "Int64" for c in ("size", "modified_at", "accessed_at", "created_at")})

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        todo = [folder for part in parts for folder in part["path"]][::-1]
        rows, listed = [], 0
        while todo and listed < budget:
            for event in _entries(todo.pop()):
                rows.append(event)
                listed += 1
                if event[0] == "folder":
                    todo.append(event[1])
            if len(rows) >= 10_000:
                yield frame(rows)
                rows = []
        yield frame(rows + [("open", folder, *[None] * 7) for folder in todo])

    return run


def crawl(spark: SparkSession, roots: list[str], budget: int = BUDGET) -> DataFrame:
    """One event for each file, folder and failure below the roots (S1), the roots being folders themselves."""
    level = spark.createDataFrame([("folder", r.rstrip("/") or "/", None, os.path.basename(r.rstrip("/")), None, None, None, None, None) for r in roots], EVENT)
    rounds, n, now = [level], len(roots), min(budget, FIRST_BUDGET)
    todo = level.select("path")
    while n:
        tasks = min(max(WORKERS[0], -(-n // FOLDERS_A_TASK)), 100 * WORKERS[1])
        level = shared.written(todo.repartition(tasks).mapInPandas(_explorer(now), EVENT), "round")
        rounds.append(level.filter("kind <> 'open'"))
        todo, now = level.filter("kind = 'open'").select("path"), budget
        n = todo.count()
    out = rounds[0]
    for other in rounds[1:]:
        out = out.union(other)
    return out


def listed(spark: SparkSession, root: str) -> DataFrame:
    """Files below a uri of any store, from its listing alone: no content is read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")
    plain = F.regexp_replace("path", "^file:/+", "/")
    return records(rows.select(plain.alias("path"), F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("modified_at")))


def records(rows: DataFrame) -> DataFrame:
    """Files (path, size, times) with name, folder, extension and kind."""
    named = rows.withColumn("name", paths.base_name(F.col("path"))).withColumn("folder_path", paths.parent(F.col("path"))).withColumn("extension", paths.extension(F.col("name")))
    return named.withColumn("media_kind", F.coalesce(paths.media_kind(F.col("extension")), F.lit("other"))).withColumn("deleted_at", F.lit(None).cast("long"))


def files_of(events: DataFrame) -> DataFrame:
    """File records of a crawl."""
    return records(events.filter("kind = 'file'").select("path", "size", "modified_at", "accessed_at", "created_at"))


def issues_of(events: DataFrame, scan_id: int) -> DataFrame:
    """Issues of the walk of a crawl (scan_id, phase, path, message)."""
    return events.filter("kind = 'error'").select(F.lit(scan_id).cast("long").alias("scan_id"), F.lit("walk").alias("phase"), "path", "message")


def capped(issues: DataFrame, scan_id: int, cap: int = catalog.ISSUE_CAP) -> DataFrame:
    """Issues of which a scan keeps its first ``cap`` (S12), as they come by phase and path."""
    own = F.col("scan_id") == scan_id
    return issues.filter(~own).unionByName(issues.filter(own).orderBy(F.desc("phase"), "path").limit(cap))


def scan_to_index(spark: SparkSession, root: str) -> tuple[DataFrame, dict[str, int]]:
    """File records of a tree, and its counts of files, folders and bytes; duplicates aren't refined."""
    events = crawl(spark, [root])
    n = events.agg(F.count_if(F.col("kind") == "file").alias("files"), F.count_if(F.col("kind") == "folder").alias("folders"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count_if(F.col("kind") == "error").alias("errors")).first()
    return files_of(events), n.asDict()


def probe(spark: SparkSession, files: DataFrame, issues: DataFrame, scan_id: int) -> tuple[DataFrame, DataFrame]:
    """Files and issues after reading again what a scan couldn't read.

    Issue paths are taken as folders (a file's as its folder) and only the
    outermost are walked; their old issues of the walk go, new ones come.
    """
    walk = capped(issues, scan_id).filter((F.col("scan_id") == scan_id) & (F.col("phase") == "walk"))
    where = walk.select("path").distinct().mapInPandas(lambda parts: (pd.DataFrame({"path": [p if os.path.isdir(p) or not os.path.exists(p) else os.path.dirname(p) for p in part["path"]]}) for part in parts), "path string")
    roots = catalog.outermost(where.distinct())
    names = [r["path"] for r in roots.collect()]  # of capped issues: ISSUE_CAP at most
    if not names:
        return files, issues
    events = crawl(spark, names)
    below = walk.select("path", F.explode(paths.ancestors(F.col("path"))).alias("up")).join(F.broadcast(roots.select(F.col("path").alias("up"))), "up", "left_semi").select("path").distinct()
    old = issues.join(below.withColumn("scan_id", F.lit(scan_id)).withColumn("phase", F.lit("walk")), ["scan_id", "phase", "path"], "left_anti")
    fresh = issues_of(events, scan_id)
    return catalog.upsert(files, files_of(events)), capped(old.select(fresh.columns).unionByName(fresh), scan_id)


def retry_issues(spark: SparkSession, files: DataFrame, issues: DataFrame, scan_id: int, mode: str = "smart") -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """:func:`probe`, then both stages of hashing again; files, issues and the counts left by phase."""
    from shelfmark.operators import duplicates

    files, issues = probe(spark, files, issues, scan_id)
    keyed = shared.written(files.withColumn("file_id", F.xxhash64("path")), "files")
    done, failed = duplicates.refine(keyed, mode)
    kept = issues.filter(~((F.col("scan_id") == scan_id) & (F.col("phase") == "hash")))
    after = kept.unionByName(failed.select(F.lit(scan_id).cast("long").alias("scan_id"), F.lit("hash").alias("phase"), "path", "message"))
    after = shared.written(after, "issues")
    n = {r["phase"]: r["count"] for r in after.filter(F.col("scan_id") == scan_id).groupBy("phase").count().collect()}
    return done.drop("file_id"), after, {"walk": n.get("walk", 0), "hash": n.get("hash", 0)}


def delete_index(spark: SparkSession, index_dir: str, index_path: str) -> bool:
    """Delete an index below the index folder; a path that leads out of it is an error."""
    home, target = os.path.realpath(index_dir), os.path.realpath(index_path)
    if target == home or not target.startswith(home + os.sep):
        raise ValueError(f"{index_path} is not below {index_dir}")
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
