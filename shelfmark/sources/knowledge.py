"""The knowledge base of the document files: facts and relations, populated once and kept.

As in any catalog, populators write their facts and queries read them. Tables of one
folder are populated on first use in a session, written to the shared folder, and
read from there by every query after, as long as the table that they were made from is the same: its
files' names, sizes and times are looked at each time, and facts of another state are dropped.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import paths
from shelfmark.operators import facts as KB
from shelfmark.sources import bindings as B
from shelfmark.sources import shared

#: Lifecycle facts of the projects: (lifecycle, confidence, may be displayed).
STAGES = [("planning", 0.5, True), ("active", 0.9, True), ("finished", 0.8, True), ("archived", 0.7, False), ("abandoned", 0.6, True)]


@dataclass
class Knowledge:
    """Tables about the document files of one folder."""

    files: DataFrame
    rule_facts: DataFrame
    derived: DataFrame
    backups: DataFrame
    facts: DataFrame
    relations: DataFrame
    lifecycles: DataFrame
    pinned: DataFrame


_KEPT: dict[tuple[str, str, str], tuple[list, Knowledge]] = {}


def _state(spark: SparkSession, sf_dir: str) -> list[tuple[str, int, int]]:
    """(name, size, time) of the files of the table that facts are made from."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/documents.parquet")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    return sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in found)


def of(spark: SparkSession, sf_dir: str) -> Knowledge:
    """The knowledge base of a folder of tables as they are now."""
    key, state = (spark.sparkContext.applicationId, shared.root(spark), sf_dir), _state(spark, sf_dir)
    seen, kept = _KEPT.get(key, (None, None))
    if seen != state or not shared.exists(kept.rule_facts):
        if kept is not None:
            drop(spark, sf_dir)
        _KEPT[key] = (state, _populated(spark, sf_dir))
    return _KEPT[key][1]


def drop(spark: SparkSession, sf_dir: str) -> None:
    """Delete the written facts of a folder."""
    _, kept = _KEPT.pop((spark.sparkContext.applicationId, shared.root(spark), sf_dir), (None, None))
    for table in (kept.rule_facts, kept.derived, kept.backups, kept.relations) if kept else ():
        shared.drop(table)


def _rule_facts(files: DataFrame) -> DataFrame:
    order = {r.id: i for i, r in enumerate(KB.RULES)}
    rank = F.lit(0)
    for name, i in order.items():
        rank = F.when(F.col("source") == name, F.lit(i)).otherwise(rank)
    return KB.rule_facts(files, asserted_at=B.AS_OF).withColumn("id", F.col("entity_id") * 100 + rank)


def _populated(spark: SparkSession, sf_dir: str) -> Knowledge:
    files = B.doc_files(spark, sf_dir)
    rules = shared.written(_rule_facts(files), "rule_facts")
    derived = shared.written(KB.derived_pairs(files), "derived")
    backups = shared.written(KB.backup_pairs(files, rules), "backups")
    member = lambda where, step: files.filter(where).select(F.col("file_id").alias("subject_id"), F.lit("partOf").alias("predicate"), ((F.col("file_id") + step) % 5).alias("object_id"))
    relations = derived.select(F.col("derivative_id").alias("subject_id"), F.lit("derivedFrom").alias("predicate"), F.col("source_id").alias("object_id"))
    relations = relations.union(backups.select("backup_id", F.lit("backupOf"), "origin_id")).union(member("file_id % 5 <> 1 AND file_id % 7 < 5", 0)).union(member("file_id % 11 = 3 AND file_id % 7 < 5", 2))
    relations = relations.union(files.filter("file_id % 12 = 2 AND file_id % 5 = 4").select("file_id", F.lit("backupOf"), F.lit(-1).cast("long")))
    one = derived.select(F.col("derivative_id").alias("entity_id")).distinct()
    fact = lambda rows, key, value, source, confidence, at, number: rows.select(
        "entity_id", F.lit(key).alias("key"), F.lit(value).alias("value"), F.lit(source).alias("source"), paths.f32(F.lit(confidence)).alias("confidence"), F.lit(True).alias("display"),
        F.lit(at).cast("long").alias("asserted_at"), (F.col("entity_id") * 100 + number).alias("id"))
    user = fact(one, "role", "derivative", "user", 1.0, B.AS_OF + 1, 50)
    regenerable = fact(one.filter("entity_id % 3 <> 0"), "replaceability", "regenerable", "heuristic:regenerable", 0.95, B.AS_OF, 51)
    facts = rules.unionByName(user).unionByName(regenerable)
    lifecycles = spark.createDataFrame([(i, s, c, B.AS_OF, d) for i, (s, c, d) in enumerate(STAGES)], "project_id long, lifecycle string, confidence double, asserted_at long, display boolean")
    pinned = files.filter("file_id % 50 = 0").select("file_id")
    return Knowledge(files, rules, derived, backups, facts, shared.written(relations, "relations"), lifecycles, pinned)
