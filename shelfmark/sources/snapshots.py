"""Versioned snapshots of a catalog (S6, S10, S18): buckets of folders, rewritten only where a scan touches them.

A table lies in a folder that driver and executors share. Files are dealt to
buckets by a hash of their folder, so a scan of one folder concerns one bucket. A version
is a file that names, for every bucket, the version that wrote it; buckets a scan doesn't
touch are named as before and not read or written. The version file is written last
and never over another, so a write that is killed leaves the older versions as they were,
and of two writers on one version one fails.

A version's description is as large as the number of buckets, whatever the table's size.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import paths
from shelfmark.operators import catalog

BUCKETS = 1024


class Conflict(RuntimeError):
    """Another writer has written this version."""


@dataclass
class Version:
    """What a version consists of: its number, each bucket's version, and what the write changed."""

    number: int
    buckets: dict[int, int] = field(default_factory=dict)
    schema: str = ""
    note: dict = field(default_factory=dict)


class Snapshots:
    """The versions of one table of files, keyed by path; every file has ``folder_path``."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS) -> None:
        """``buckets`` is fixed by the first version."""
        self.spark, self.root, self.count = spark, root.rstrip("/"), buckets

    # Files by Hadoop's file systems ---------------------------------------------------

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _system(self):
        return self._path("versions").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        """Numbers of the whole versions, ascending."""
        system, folder = self._system(), self._path("versions")
        if not system.exists(folder):
            return []
        return sorted(int(s.getPath().getName()) for s in system.listStatus(folder) if s.getPath().getName().isdigit())

    def version(self, number: int | None = None) -> Version:
        """A version's description; the latest one if no number is given, an empty one if there is none."""
        found = self.numbers()
        if number is None:
            if not found:
                return Version(-1)
            number = found[-1]
        if number not in found:
            raise KeyError(f"no version {number}")
        lines = self.spark.read.text(f"{self.root}/versions/{number:012d}").collect()  # one line
        got = json.loads(lines[0]["value"])
        return Version(number, {int(b): v for b, v in got["buckets"].items()}, got["schema"], got["note"])

    def _commit(self, version: Version) -> None:
        system, final = self._system(), self._path("versions", f"{version.number:012d}")
        body = json.dumps({"buckets": version.buckets, "schema": version.schema, "note": version.note}).encode()
        try:
            out = system.create(final, False)
        except Exception as e:  # the gateway wraps the file system's error
            raise Conflict(f"version {version.number} exists") from e
        out.write(bytearray(body))
        out.close()

    # Reading ----------------------------------------------------------------------

    def bucket_of(self, folder: Column) -> Column:
        """Bucket of a folder."""
        return F.pmod(F.xxhash64(folder), F.lit(self.count)).cast("int")

    def read(self, number: int | None = None, buckets: list[int] | None = None) -> DataFrame | None:
        """The files of a version, or of some of its buckets; None if nothing was ever written."""
        version = self.version(number) if number is None or number >= 0 else Version(-1)
        if version.number < 0:
            return None
        some = version.buckets if buckets is None else {b: version.buckets[b] for b in buckets if b in version.buckets}
        if not some:
            return self.spark.createDataFrame([], version.schema)
        where = [f"{self.root}/data/v={v}/bucket={b}" for b, v in some.items()]
        return self.spark.read.schema(version.schema).parquet(*where)

    def folder(self, folder: str, number: int | None = None) -> DataFrame | None:
        """The files directly in one folder: one bucket is read."""
        bucket = self.spark.range(1).select(self.bucket_of(F.lit(folder)).alias("b")).first()["b"]
        rows = self.read(number, [bucket])
        return None if rows is None else rows.filter(F.col("folder_path") == folder)

    # Writing ----------------------------------------------------------------------

    def _write(self, rows: DataFrame, number: int, schema: str) -> None:
        """Rows (with ``bucket``) as this version's buckets."""
        dealt = rows.repartition("bucket")
        dealt.write.partitionBy("bucket").mode("overwrite").parquet(f"{self.root}/data/v={number}")

    def scan(self, new: DataFrame, root: str, at: int, note: dict | None = None) -> Version:
        """The next version after a scan of everything below ``root``.

        Files are kept, changed, revived and added as by :func:`catalog.upsert`; files below ``root`` that
        the scan doesn't hold are marked as deleted at ``at`` (S10). Only buckets of folders that the scan or
        the deleted files lie in are read and written.
        """
        last = self.version()
        new = new.withColumn("bucket", self.bucket_of(F.col("folder_path")))
        if last.number < 0:
            rows = new
            for c in catalog.HASHES:
                rows = rows if c in rows.columns else rows.withColumn(c, F.lit(None).cast("string"))
            rows = rows if "hash_state" in rows.columns else rows.withColumn("hash_state", F.lit(0))
            rows = rows if "deleted_at" in rows.columns else rows.withColumn("deleted_at", F.lit(None).cast("long"))
            touched = [r["bucket"] for r in rows.select("bucket").distinct().collect()]  # a row for each bucket
        else:
            # Buckets below ``root``: of the scan, and of live folders there that it may have emptied.
            known = self.read().filter("deleted_at IS NULL").filter(paths.under(F.col("folder_path"), root)).select(self.bucket_of(F.col("folder_path")).alias("bucket"))
            touched = [r["bucket"] for r in known.union(new.select("bucket")).distinct().collect()]  # a row for each bucket
            old = self.read(buckets=touched)
            merged = catalog.upsert(old, new.drop("bucket"))
            gone = catalog.tombstones(old, new, root).select("path", F.lit(True).alias("_gone"))
            rows = merged.join(gone, "path", "left").withColumn("deleted_at", F.when(F.col("_gone"), F.lit(at).cast("long")).otherwise(F.col("deleted_at"))).drop("_gone")
            rows = rows.withColumn("bucket", self.bucket_of(F.col("folder_path")))
        number = last.number + 1
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "bucket")
        if not touched:
            version = Version(number, dict(last.buckets), last.schema or schema, note or {})
        else:
            self._write(rows, number, schema)
            version = Version(number, {**last.buckets, **dict.fromkeys(touched, number)}, schema, (note or {}) | {"touched": len(touched)})
        self._commit(version)
        return version

    def amend(self, new: DataFrame, note: dict | None = None) -> Version:
        """The next version with some columns of some files replaced: ``new`` has path, folder_path and these columns."""
        last, named = self.version(), [c for c in new.columns if c not in ("path", "folder_path")]
        keyed = new.withColumn("bucket", self.bucket_of(F.col("folder_path")))
        touched = [r["bucket"] for r in keyed.select("bucket").distinct().collect()]  # a row for each bucket
        version = Version(last.number + 1, {**last.buckets, **dict.fromkeys(touched, last.number + 1)}, last.schema, (note or {}) | {"touched": len(touched)})
        if touched:
            old = self.read(buckets=touched)
            joined = old.join(new.select("path", F.struct(*named).alias("_new")), "path", "left")
            rows = joined.select([F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in named else F.col(c) for c in old.columns])
            self._write(rows.withColumn("bucket", self.bucket_of(F.col("folder_path"))), version.number, last.schema)
        self._commit(version)
        return version

    def changes(self, before: int, after: int) -> DataFrame:
        """Files that differ between two versions: path and the two rows (``old``, ``new``), null where it isn't live.

        Only buckets that differ are read.
        """
        a, b = self.version(before) if before >= 0 else Version(-1), self.version(after)
        differ = [k for k in {*a.buckets, *b.buckets} if a.buckets.get(k) != b.buckets.get(k)]
        def rows(n: int) -> DataFrame:
            got = self.read(n, differ)
            return got if got is not None else self.spark.createDataFrame([], b.schema)

        live = lambda n: catalog.live(rows(n)).select("path", F.struct("folder_path", "size", "extension").alias("row"))
        joined = live(before).withColumnRenamed("row", "old").join(live(after).withColumnRenamed("row", "new"), "path", "full")
        return joined.filter(~F.col("old").eqNullSafe(F.col("new")))

    def vacuum(self, keep: int = 2) -> int:
        """Delete all but the latest ``keep`` versions, and data that no version left names; how many versions went."""
        system, numbers = self._system(), self.numbers()
        old, left = numbers[:-keep] if keep else numbers, numbers[-keep:] if keep else []
        named = {(v, b) for n in left for b, v in self.version(n).buckets.items()}
        for n in old:
            system.delete(self._path("versions", f"{n:012d}"), False)
        data = self._path("data")
        for folder in system.listStatus(data) if system.exists(data) else []:
            v = int(folder.getPath().getName().removeprefix("v="))
            if left and v > left[-1]:
                continue  # a write that isn't whole yet
            buckets = [s.getPath() for s in system.listStatus(folder.getPath()) if s.getPath().getName().startswith("bucket=")]
            unnamed = [p for p in buckets if (v, int(p.getName().removeprefix("bucket="))) not in named]
            for p in unnamed:
                system.delete(p, True)
            if len(unnamed) == len(buckets):
                system.delete(folder.getPath(), True)
        return len(old)
