"""An index of file trees: crawl, snapshot, duplicates, totals and facts, in one folder.

Everything lies below one folder that driver and executors share:

- ``files``: the versioned snapshot (:class:`Snapshots`), its hashes filled in by a second version of a scan;
- ``decisions``: what the user decided (:class:`DecisionLog`);
- ``sessions``, ``issues``: a row a scan, and what it couldn't read (capped);
- ``totals``, ``sums``: totals of every folder, kept up by what a scan changed;
- ``facts``, ``discoveries``: what the populators say of a version.

:meth:`Index.scan` crawls one folder of it and rewrites only what that concerns;
:meth:`Index.enrich` runs the populators; both return their counts.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import paths
from shelfmark.operators import catalog, deltas, duplicates, extract
from shelfmark.operators import decisions as decided
from shelfmark.operators import facts as kb
from shelfmark.sources import contents, filesystem, shared
from shelfmark.sources.decision_log import DecisionLog
from shelfmark.sources.snapshots import BUCKETS, Snapshots

SESSION = "id long, root string, started_at long, files long, folders long, bytes long, inaccessible_entries long"
FACT = ["entity_id", "key", "value", "source", "confidence", "display", "asserted_at"]


class Index:
    """The index in one folder; nothing is there until the first scan."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS) -> None:
        """Open it."""
        self.spark, self.folder_ = spark, folder.rstrip("/")
        self.snapshots, self.decisions = Snapshots(spark, f"{self.folder_}/files", buckets), DecisionLog(spark, f"{self.folder_}/decisions")

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder_}/{name}")
        except AnalysisException:  # not written yet
            return self.spark.createDataFrame([], schema)

    def files(self, version: int | None = None) -> DataFrame | None:
        """The files of a version with their ids."""
        rows = self.snapshots.read(version)
        return None if rows is None else rows.withColumn("file_id", F.xxhash64("path"))

    def sessions(self) -> DataFrame:
        """A row a scan: the timeline of the index."""
        return self._read("sessions", SESSION)

    def issues(self) -> DataFrame:
        """What scans couldn't read: (scan_id, phase, path, message)."""
        return self._read("issues", "scan_id long, phase string, path string, message string")

    def totals(self) -> DataFrame:
        """(path, total_files, total_bytes) of every folder with live files below it, as of the last version."""
        return self._read(f"totals/{self.snapshots.version().number:012d}", "path string, total_files long, total_bytes long")

    def dominant(self) -> DataFrame:
        """(path, value, bytes): each folder's extension with most bytes."""
        return deltas.dominant(self._read(f"sums/{self.snapshots.version().number:012d}", "path string, value string, files long, bytes long"))

    def _keep_up(self, before: int) -> None:
        """Write totals and sums of the version now, from those of ``before`` and the changes since."""
        now = self.snapshots.version().number
        changed = shared.written(self.snapshots.changes(before, now), "changes")
        old = lambda name, schema: self._read(f"{name}/{before:012d}", schema) if before >= 0 else self.spark.createDataFrame([], schema)
        deltas.totals(old("totals", "path string, total_files long, total_bytes long"), changed).write.mode("overwrite").parquet(f"{self.folder_}/totals/{now:012d}")
        deltas.changed_value_sums(old("sums", "path string, value string, files long, bytes long"), changed).write.mode("overwrite").parquet(f"{self.folder_}/sums/{now:012d}")
        shared.drop(changed)

    def scan(self, root: str, at: int, mode: str = "smart") -> dict[str, int]:
        """Crawl one folder, write the next version, and hash what may be a duplicate."""
        before, scan_id = self.snapshots.version().number, at
        events = filesystem.crawl(self.spark, [root])
        n = events.agg(F.count_if(F.col("kind") == "file").alias("files"), F.count_if(F.col("kind") == "folder").alias("folders"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count_if(F.col("kind") == "error").alias("errors")).first()
        self.snapshots.scan(filesystem.files_of(events), root, at, {"scan": scan_id, "root": root})
        files = self.files()
        done, failed = duplicates.refine(files, mode)
        hashes = ["partial_hash", "sample_hash", "full_hash", "hash_state", "hash_algorithm"]
        old = files.select("path", F.struct(*hashes).alias("_old"))
        new = done.join(old, "path").filter(~F.struct(*hashes).eqNullSafe(F.col("_old"))).select("path", "folder_path", *hashes)
        failed = shared.written(failed, "failed")
        if mode != "metadata":
            self.snapshots.amend(shared.written(new, "hashed"), {"scan": scan_id, "hashed": True})
        walk = filesystem.issues_of(events, scan_id)
        issues = walk.unionByName(failed.select(F.lit(scan_id).cast("long").alias("scan_id"), F.lit("hash").alias("phase"), "path", "message"))
        filesystem.capped(issues, scan_id).write.mode("append").parquet(f"{self.folder_}/issues")
        session = (scan_id, root, at, n["files"], n["folders"], n["bytes"], n["errors"])
        self.spark.createDataFrame([session], SESSION).coalesce(1).write.mode("append").parquet(f"{self.folder_}/sessions")
        self._keep_up(before)
        return {"version": self.snapshots.version().number, **n.asDict(), "hash_issues": failed.count()}

    def duplicate_groups(self) -> DataFrame:
        """Live files equal in size and hashes (A10)."""
        return duplicates.groups(self.files())

    def enrich(self, at: int) -> dict[str, int]:
        """Run the populators over the live files: rules, contents, heuristics, image hashes.

        Writes ``facts`` and ``discoveries`` of the version; what the user rejected is left out.
        """
        version, negative = self.snapshots.version().number, self.decisions.negatives()
        files = shared.written(catalog.live(self.files()), "live")
        no_facts = files.sparkSession.createDataFrame([], "entity_id long, key string, value string, source string")
        rules = shared.written(kb.emit(kb.rule_facts(files, asserted_at=at), no_facts, decided.rejected_properties(negative)), "rules")
        readable = contents.heads(files.filter(F.lower("extension").isin(*extract.EXTRACTED)).select("file_id", "path", "size", "extension"), extract.HEAD)
        found = extract.displayed_facts(extract.extracted_facts(readable), kb.resolve(rules.withColumn("id", F.col("entity_id"))))
        found = found.withColumn("asserted_at", F.lit(at).cast("long"))
        facts = rules.select(*FACT).unionByName(kb.emit(found, rules, decided.rejected_properties(negative)).select(*FACT))
        rejected = decided.rejected_pairs(negative)
        derived = kb.unrejected(kb.derived_pairs(files).select("derivative_id", "source_id", "confidence"), rejected, "derivedFrom", "derivative_id", "source_id")
        backups = kb.unrejected(kb.backup_pairs(files, rules).select("backup_id", "origin_id", "confidence"), rejected, "backupOf", "backup_id", "origin_id")
        images = contents.heads(files.filter(F.lower(F.coalesce("extension", F.lit(""))).isin(*extract.IMAGES)).select("file_id", "path", "size", "extension"), extract.IMAGE_HEAD)
        near = kb.near_class_pairs(shared.written(extract.image_hashes(images), "images"))
        near = kb.unrejected(near, rejected, "nearDuplicateOf", "left_id", "right_id").select("left_id", "right_id", kb.near_confidence(F.col("distance")).alias("confidence"))
        rows = [part.select(F.lit(kind).alias("kind"), F.col(part.columns[0]).alias("subject_id"), F.col(part.columns[1]).alias("object_id"), "confidence") for kind, part in (("derivedFrom-pattern", derived), ("backupOf-pair", backups), ("near-duplicate-cluster", near))]
        discoveries = rows[0].union(rows[1]).union(rows[2]).withColumns({"id": F.concat_ws("#", "kind", "subject_id", "object_id"), "status": F.lit("pending")})
        facts.write.mode("overwrite").parquet(f"{self.folder_}/facts/{version:012d}")
        discoveries.write.mode("overwrite").parquet(f"{self.folder_}/discoveries/{version:012d}")
        return {"facts": self.facts().count(), "discoveries": self.discoveries().count()}

    def facts(self) -> DataFrame:
        """Facts of the last version that was enriched."""
        return self._read(f"facts/{self.snapshots.version().number:012d}", "entity_id long, key string, value string, source string, confidence double, display boolean, asserted_at long")

    def discoveries(self) -> DataFrame:
        """Discoveries of the last version that was enriched, with the status that the user's decisions give them."""
        return self.decisions.statuses(self._read(f"discoveries/{self.snapshots.version().number:012d}", "kind string, subject_id long, object_id long, confidence double, id string, status string"))

    def search(self, **by) -> DataFrame:
        """Live files by text, expression, extension, kind and size (:func:`catalog.search`)."""
        return catalog.search(self.files(), **by)

    def below(self, folder: str) -> DataFrame:
        """Live files in or below a folder."""
        return catalog.live(self.files()).filter(paths.under(F.col("path"), folder))
