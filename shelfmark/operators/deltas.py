"""Stored totals kept up by what changed (A7, A8, A12), not rolled up anew.

A change is a file's old and new row (:meth:`Snapshots.changes`). Its signed
difference climbs from the folders concerned and is added to the stored totals, so the work
follows the change; stored rows that it doesn't reach are only copied, or left where
they are by a bucketed writer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions import paths


def signed(changes: DataFrame) -> DataFrame:
    """(folder_path, extension, size, sign): old rows with -1, new ones with 1."""
    side = lambda c, sign: changes.filter(F.col(c).isNotNull()).select(f"{c}.folder_path", f"{c}.extension", f"{c}.size", F.lit(sign).cast("long").alias("sign"))
    return side("old", -1).union(side("new", 1))


def folder_changes(changes: DataFrame) -> DataFrame:
    """(path, files, bytes): what each folder with all below it gains or loses."""
    direct = signed(changes).groupBy("folder_path").agg(F.sum("sign").alias("n"), F.sum(F.col("sign") * F.col("size")).alias("b"))
    up = direct.filter("n <> 0 OR b <> 0").select(F.explode(paths.ancestors(F.col("folder_path"))).alias("path"), "n", "b")
    return up.groupBy("path").agg(F.sum("n").alias("files"), F.sum("b").alias("bytes")).filter("files <> 0 OR bytes <> 0")


def totals(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """Stored totals (path, total_files, total_bytes) with the changes added (A8); folders left without files go."""
    moved = folder_changes(changes)
    joined = stored.join(moved, "path", "full")
    added = lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
    return joined.select("path", added("total_files", "files").alias("total_files"), added("total_bytes", "bytes").alias("total_bytes")).filter("total_files > 0")


def direct_totals(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """Stored direct counts (folder_path, direct_files, direct_bytes) with the changes added."""
    moved = signed(changes).groupBy("folder_path").agg(F.sum("sign").alias("n"), F.sum(F.col("sign") * F.col("size")).alias("b"))
    joined = stored.join(moved, "folder_path", "full")
    added = lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
    return joined.select("folder_path", added("direct_files", "n").alias("direct_files"), added("direct_bytes", "b").alias("direct_bytes")).filter("direct_files > 0")


def value_sums(files: DataFrame, value: str = "extension") -> DataFrame:
    """(path, value, files, bytes) of every folder with all below it: what :func:`dominant` chooses from."""
    direct = files.filter(F.col(value).isNotNull()).groupBy("folder_path", F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.greatest(F.lit(0), "size")).alias("b"))
    up = direct.select(F.explode(paths.ancestors(F.col("folder_path"))).alias("path"), "value", "n", "b")
    return up.groupBy("path", "value").agg(F.sum("n").alias("files"), F.sum("b").alias("bytes"))


def changed_value_sums(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """:func:`value_sums` with the changes added; values left without files go."""
    direct = signed(changes).filter("extension IS NOT NULL").groupBy("folder_path", F.col("extension").alias("value"))
    direct = direct.agg(F.sum("sign").alias("n"), F.sum(F.col("sign") * F.greatest(F.lit(0), "size")).alias("b")).filter("n <> 0 OR b <> 0")
    moved = direct.select(F.explode(paths.ancestors(F.col("folder_path"))).alias("path"), "value", "n", "b").groupBy("path", "value").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    added = lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
    return stored.join(moved, ["path", "value"], "full").select("path", "value", added("files", "n").alias("files"), added("bytes", "b").alias("bytes")).filter("files > 0")


def dominant(sums: DataFrame) -> DataFrame:
    """(path, value, bytes): each folder's value with most bytes, the smallest on ties."""
    best = Window.partitionBy("path").orderBy(F.desc("bytes"), "value")
    return sums.withColumn("r", F.row_number().over(best)).filter("r = 1").select("path", "value", "bytes")
