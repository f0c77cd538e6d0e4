"""Operators over files and folders: scans, filters, rollups, histograms, top lists.

Files have file_id, folder_path, name, path, extension, size, modified_at,
deleted_at (null: live) and media_kind. Each operator is a function from
DataFrames to a DataFrame and leaves joins and pushdown to the planner.
"""

from __future__ import annotations

import re

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions import paths
from shelfmark.operators import ordered
from shelfmark.sources import shared

ISSUE_CAP = 500


def live(files: DataFrame) -> DataFrame:
    """Files that aren't deleted (F1)."""
    return files.filter(F.col("deleted_at").isNull())


# Snapshots -----------------------------------------------------------------


#: What a hash depends on, and the hashes of a file with their algorithm.
WATCHED = ("size", "modified_at", "created_at")
HASHES = ("partial_hash", "sample_hash", "full_hash", "hash_algorithm")


def upsert(old: DataFrame, new: DataFrame, hashes: tuple[str, ...] = HASHES, watched: tuple[str, ...] = WATCHED) -> DataFrame:
    """New snapshot of files by path: kept, changed, revived and added rows.

    Every column of the new scan (name, folder, extension, kind, times) replaces
    the old one. A file of which one of ``watched`` differs loses its hashes; files
    that the new scan doesn't hold stay as they are.
    """
    o, n = old.alias("o"), new.alias("n")
    same = F.lit(True)
    for c in watched:
        same = same & F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))
    seen = F.col("n.path").isNotNull()
    kept = F.col("o.path").isNotNull() & ~(seen & ~same)
    scanned = [c for c in new.columns if c not in ("path", "deleted_at", "hash_state", *hashes)]
    columns = [F.coalesce("n.path", "o.path").alias("path"), *[(F.when(seen, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) if c in old.columns else F.col(f"n.{c}")).alias(c) for c in scanned]]
    columns += [F.when(kept, F.col(f"o.{h}")).alias(h) for h in hashes]
    columns += [F.when(~seen, F.col("o.deleted_at")).alias("deleted_at"), F.when(kept, F.coalesce("o.hash_state", F.lit(0))).otherwise(0).alias("hash_state")]
    return o.join(n, F.col("o.path") == F.col("n.path"), "full").select(*columns)


def tombstones(old: DataFrame, new: DataFrame, root: str) -> DataFrame:
    """Live files under a root that the new scan doesn't hold."""
    return live(old).filter(paths.under(F.col("path"), root)).join(new.select("path"), "path", "left_anti")


def mark_deleted(files: DataFrame, gone: list[str], at: int) -> DataFrame:
    """Files with some paths marked as deleted."""
    return files.withColumn("deleted_at", F.when(F.col("path").isin(gone), F.lit(at)).otherwise(F.col("deleted_at")))


def placeholder_totals(stored: DataFrame, direct: DataFrame) -> DataFrame:
    """Totals of folders until the next rollup: the larger of what is stored and what lies directly in them.

    ``stored`` has path, total_files and total_bytes; ``direct`` is of :func:`folder_records`.
    """
    d = direct.select(F.col("folder_path").alias("path"), "direct_files", "direct_bytes")
    larger = lambda a, b: F.greatest(F.coalesce(a, F.lit(0)), F.coalesce(b, F.lit(0)))
    return stored.join(d, "path", "full").select("path", larger("total_files", "direct_files").alias("total_files"), larger("total_bytes", "direct_bytes").alias("total_bytes"))


def folder_records(files: DataFrame) -> DataFrame:
    """Direct files and bytes of each folder."""
    return files.groupBy("folder_path").agg(F.count(F.lit(1)).alias("direct_files"), F.sum("size").alias("direct_bytes"))


def folders(files: DataFrame) -> DataFrame:
    """Every folder with its ancestors: path, parent, name, depth."""
    found = files.select("folder_path").distinct().select(F.explode(paths.ancestors(F.col("folder_path"))).alias("path")).distinct()
    up = paths.parent(F.col("path"))
    return found.select("path", F.when(up != "", up).alias("parent_path"), paths.base_name(F.col("path")).alias("name"), paths.depth(F.col("path")).alias("depth"))


def issue_sink(issues: DataFrame, cap: int = ISSUE_CAP) -> DataFrame:
    """The first ``cap`` issues of each scan."""
    first = Window.partitionBy("scan_id").orderBy("created_at", "id")
    return issues.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= cap).drop("r")


def issue_list(issues: DataFrame, sessions: DataFrame, limit: int = 100) -> DataFrame:
    """Issues of the session that started last, by phase and path."""
    latest = latest_session(sessions).select(F.col("id").alias("scan_id"))
    return issues.join(F.broadcast(latest), "scan_id", "left_semi").orderBy("phase", "path", "id").limit(limit)  # one row


def issue_counts(issues: DataFrame, sessions: DataFrame) -> DataFrame:
    """Issues of the session that started last (S14): its own tally of the walk, the kept rows of the hash phase.

    Sessions have inaccessible_entries, which no cap touches. No session gives zeros.
    """
    latest = latest_session(sessions).filter("id IS NOT NULL").select(F.col("id").alias("scan_id"), F.col("inaccessible_entries").alias("walk"))
    hashed = issues.filter("phase = 'hash'").join(F.broadcast(latest), "scan_id", "left_semi").agg(F.count(F.lit(1)).alias("hash_issues"))
    return hashed.join(latest, F.lit(True), "left").select(F.coalesce("walk", F.lit(0)).cast("long").alias("walk_issues"), "hash_issues")


def index_catalog(sessions: DataFrame, index: str = "index_path") -> DataFrame:
    """The latest session of each index, newest first."""
    return sessions.groupBy(index).agg(F.max_by(F.struct(*[c for c in sessions.columns if c != index]), F.struct("started_at", "id")).alias("s")).select(index, "s.*").orderBy(F.desc("started_at"), index)


def latest_session(sessions: DataFrame) -> DataFrame:
    """The session that started last."""
    return sessions.agg(F.max_by(F.struct(*sessions.columns), F.struct("started_at", "id")).alias("s")).select("s.*")


# Search --------------------------------------------------------------------


def substring_search(files: DataFrame, query: str, limit: int = 100) -> DataFrame:
    """Live files whose name or path holds the text, ASCII case aside; nothing for an empty text (F2)."""
    text = query.strip()
    if not text:
        return live(files).limit(0)
    return _ranked(live(files).filter(_contains(text)), limit)


def _contains(text: str) -> Column:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    wanted = F.lit(text.translate(str.maketrans(upper, lower)))
    return F.contains(F.translate("name", upper, lower), wanted) | F.contains(F.translate("path", upper, lower), wanted)


def _ranked(files: DataFrame, limit: int) -> DataFrame:
    return files.orderBy(F.desc("size"), F.desc_nulls_last("modified_at"), "file_id").limit(limit)


def search(
    files: DataFrame, text: str = "", regex: str | None = None, extensions: list[str] | None = None, kinds: list[str] | None = None,
    least: int | None = None, most: int | None = None, limit: int = 100,
) -> DataFrame:
    """Live files by any of: text, regular expression, extension, kind, size.

    No text means no condition on it. A broken expression gives nothing; the
    limit holds after the expression. ``(?P<name>`` may name a group.
    """
    out = live(files)
    if regex is not None:
        pattern = jvm_pattern(files, regex)
        if pattern is None:
            return out.limit(0)
        out = out.filter(F.col("name").rlike(pattern) | F.col("path").rlike(pattern))
    elif text.strip():
        out = out.filter(_contains(text.strip()))
    if extensions:
        out = out.filter(F.col("extension").isin([e.lower() for e in extensions]))
    if kinds:
        out = out.filter(F.col("media_kind").isin([k.lower() for k in kinds]))
    if least is not None:
        out = out.filter(F.col("size") >= least)
    if most is not None:
        out = out.filter(F.col("size") <= most)
    return _ranked(out, limit)


def jvm_pattern(files: DataFrame, regex: str) -> str | None:
    """The expression as Spark takes it, with named groups and references to them in its form; None if Spark finds it broken."""
    pattern = re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", regex.replace("(?P<", "(?<"))
    try:
        files.sparkSession.range(1).select(F.lit("").rlike(pattern)).collect()  # one row
    except PySparkException:
        return None
    return pattern


def stale_files(files: DataFrame, as_of: int, days: int = 365, limit: int = 8) -> DataFrame:
    """Largest live files not modified for some days."""
    return live(files).filter(F.col("modified_at") < as_of - days * paths.DAY).orderBy(F.desc("size"), "file_id").limit(limit)


def outermost(candidates: DataFrame) -> DataFrame:
    """Paths that lie under no other path of the set (F16): each is looked up among the others' ancestors."""
    named = candidates.select("path", paths.normal(F.col("path")).alias("plain")).distinct()
    inner = named.select("path", F.explode(paths.above(F.col("plain"))).alias("above"))
    covered = inner.join(named.select(F.col("plain").alias("above")).distinct(), "above", "left_semi").select("path").distinct()
    return candidates.join(covered, "path", "left_anti")


# Rollups and histograms -----------------------------------------------------


def extension_stats(files: DataFrame) -> DataFrame:
    """Live files and bytes by extension (A1)."""
    return live(files).filter(F.col("extension").isNotNull()).groupBy("extension").agg(F.count(F.lit(1)).alias("file_count"), F.sum("size").alias("total_bytes"))


def media_stats(files: DataFrame) -> DataFrame:
    """Live files and bytes by media kind (A2)."""
    return live(files).groupBy("media_kind").agg(F.count(F.lit(1)).alias("file_count"), F.sum("size").alias("total_bytes"))


def folder_media(files: DataFrame) -> DataFrame:
    """Live direct files and bytes by folder and media kind (A3)."""
    return live(files).groupBy("folder_path", "media_kind").agg(F.count(F.lit(1)).alias("file_count"), F.sum("size").alias("total_bytes"))


def month_histogram(files: DataFrame) -> DataFrame:
    """Live files and bytes by month (A4)."""
    return live(files).groupBy(paths.month(F.col("modified_at")).alias("bucket")).agg(F.count(F.lit(1)).alias("file_count"), F.sum("size").alias("total_bytes"))


def timeline(files: DataFrame, as_of: int, months: int = 24) -> DataFrame:
    """Month histogram over the last months, up to the month of tomorrow (A5)."""
    now = F.timestamp_seconds(F.lit(as_of))
    lo, hi = F.date_format(F.add_months(now, -months), "yyyy-MM"), F.date_format(F.timestamp_seconds(F.lit(as_of + paths.DAY)), "yyyy-MM")
    return month_histogram(files).filter((F.col("bucket") != "unknown") & F.col("bucket").between(lo, hi)).orderBy("bucket")


def age_bands(files: DataFrame, as_of: int) -> DataFrame:
    """Live files and bytes by age band."""
    return live(files).groupBy(paths.age_band(F.col("modified_at"), as_of).alias("band")).agg(F.count(F.lit(1)).alias("file_count"), F.sum("size").alias("total_bytes"))


def rollup(files: DataFrame) -> DataFrame:
    """Files and bytes of every folder with all below it (A8), in one pass.

    Files are summed per folder before they climb, so the explosion to ancestors
    has a row per folder and level, not per file and level. Fit for small sets of
    folders; :func:`trees.totals` needs no such explosion.
    """
    direct = files.groupBy("folder_path").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b"))
    up = direct.select(F.explode(paths.ancestors(F.col("folder_path"))).alias("path"), "n", "b")
    return up.groupBy("path").agg(F.sum("n").alias("total_files"), F.sum("b").alias("total_bytes"))


def folder_totals(files: DataFrame) -> DataFrame:
    """Every folder, also an empty one, with its live total (A8 after T15)."""
    return folders(files).join(rollup(live(files)), "path", "left").select("path", "depth", F.coalesce("total_files", F.lit(0)).alias("total_files"), F.coalesce("total_bytes", F.lit(0)).alias("total_bytes"))


def children(totals: DataFrame, parent_path: str, limit: int = 500) -> DataFrame:
    """A folder's largest children (J1, T-2)."""
    return totals.filter((paths.parent(F.col("path")) == parent_path) & (F.col("total_bytes") > 0)).orderBy(F.desc("total_bytes"), "path").limit(limit)


def largest(rows: DataFrame, by: str, tie: str, limit: int) -> DataFrame:
    """Top rows by a positive measure (T-1, T-3, T-4, T-5)."""
    return rows.filter(F.col(by) > 0).orderBy(F.desc(by), tie).limit(limit)


def dominant(files: DataFrame, value: str) -> DataFrame:
    """Per folder with all below it, the value with most bytes; ties to the smallest."""
    direct = files.filter(F.col(value).isNotNull()).groupBy("folder_path", value).agg(F.sum(F.greatest(F.lit(0), "size")).alias("b"))
    up = direct.select(F.explode(paths.ancestors(F.col("folder_path"))).alias("path"), F.col(value).alias("value"), "b")
    sums = up.groupBy("path", "value").agg(F.sum("b").alias("bytes"))
    best = Window.partitionBy("path").orderBy(F.desc("bytes"), "value")
    return sums.withColumn("r", F.row_number().over(best)).filter("r = 1").select("path", "value", "bytes")


def ancestor_files(files: DataFrame, known: DataFrame) -> DataFrame:
    """Each file with every known folder above it."""
    return files.select("file_id", F.explode(paths.ancestors(F.col("folder_path"))).alias("path")).join(known.select("path"), "path", "left_semi")


def nearest_ancestor(some: DataFrame) -> DataFrame:
    """For each of some folders the nearest other one above it, if any."""
    up = some.select("path", F.explode(paths.above(F.col("path"))).alias("above"))
    met = up.join(some.select(F.col("path").alias("above")), "above").groupBy("path").agg(F.max_by("above", F.length("above")).alias("parent_path"))
    return some.select("path").join(met, "path", "left")


def scope_children(folders: DataFrame, scope: str | None) -> DataFrame:
    """What a folder view draws (L7): of ``folders`` (path, total_files, total_bytes) those whose nearest other one above is ``scope``, largest first.

    Without a scope, or with one that isn't among them, the outermost folders. Adds ``name`` and ``has_children``.
    """
    up = shared.written(nearest_ancestor(folders), "parents")
    parents = up.select(F.col("parent_path").alias("path")).filter("path IS NOT NULL").distinct().withColumn("has_children", F.lit(True))
    known = scope is not None and bool(folders.filter(F.col("path") == scope).limit(1).count())
    drawn = up.filter(F.col("parent_path") == scope) if known else up.filter("parent_path IS NULL")
    rows = folders.join(drawn.select("path"), "path").join(parents, "path", "left")
    return rows.select("path", paths.base_name(F.col("path")).alias("name"), "total_files", "total_bytes", F.coalesce("has_children", F.lit(False)).alias("has_children")).orderBy(F.desc("total_bytes"), "path")


def timeline_insights(months: DataFrame) -> DataFrame:
    """Busiest, fullest and quietest month, the earliest on ties, and bytes per month."""
    known = months.filter("bucket <> 'unknown'")
    early = F.translate("bucket", "0123456789", "9876543210")  # so that the maximum takes the earliest
    return known.agg(
        F.max_by("bucket", F.struct("total_bytes", early)).alias("busiest"), F.max_by("bucket", F.struct("file_count", early)).alias("peak"),
        F.min_by("bucket", F.struct("file_count", "bucket")).alias("quietest"), F.expr("sum(total_bytes) DIV count(1)").alias("bytes_per_month"),
    )


def age_shares(bands: DataFrame) -> DataFrame:
    """Share of files of half a year and more, and of bytes of a year and more, in percent."""
    part = lambda some, measure: F.coalesce(F.sum(F.when(F.col("band").isin(*some), F.col(measure))), F.lit(0))
    share = lambda some, measure: F.when(F.sum(measure) > 0, 100.0 * part(some, measure) / F.sum(measure)).otherwise(F.lit(0.0))
    return bands.agg(share(("6to12mo", "1to2yr", "gt2yr"), "file_count").alias("old_files"), share(("1to2yr", "gt2yr"), "total_bytes").alias("old_bytes"))


def sorted_files(files: DataFrame, by: str = "size", limit: int = 200) -> DataFrame:
    """Live files by ``size``, ``newest`` or ``oldest``; missing times last, those by size (T-10)."""
    order = {"size": [], "newest": [F.desc_nulls_last("modified_at")], "oldest": [F.asc_nulls_last("modified_at")]}[by]
    return live(files).orderBy(*order, F.desc("size"), "file_id").limit(limit)


def page(rows: DataFrame, order: list[tuple[str, str]], size: int, after: dict | None = None) -> DataFrame:
    """The next ``size`` rows of an order after the row ``after``, a dict of its order columns (T-6, T-8).

    ``order`` is of (column, "asc" or "desc") and tells rows apart; nulls come last. The
    place is a filter on the rows, not an offset: a page reads what can lie on it and keeps a
    page's rows a task, however far down it is.
    """
    if after is not None:
        later, same = F.lit(False), F.lit(True)
        for name, way in order:
            value, column = F.lit(after[name]), F.col(name)
            if after[name] is None:
                same = same & column.isNull()
                continue
            beyond = column > value if way == "asc" else column < value
            later = later | (same & (beyond | column.isNull()))
            same = same & (column == value)
        # What the first column alone rules out can be left to the scan.
        name, way = order[0]
        if after[name] is not None:
            column = F.col(name)
            rows = rows.filter(column.isNull() | (column >= F.lit(after[name]) if way == "asc" else column <= F.lit(after[name])))
        rows = rows.filter(later)
    return rows.orderBy(*[F.asc_nulls_last(n) if way == "asc" else F.desc_nulls_last(n) for n, way in order]).limit(size)


def prefix_tree(rows: DataFrame) -> DataFrame:
    """Rows (path, size) as a tree of path segments, their common beginning folded into the root.

    Gives path, parent_path, name, depth (the root's is 0) and bytes; a negative size
    counts as 0. The common beginning never takes a row's last segment.
    """
    segments = F.filter(F.split("path", r"[/\\]"), lambda s: s != "")
    split = rows.select(segments.alias("s"), F.greatest(F.lit(0), "size").alias("bytes"), F.contains("path", F.lit("\\")).alias("back")).filter(F.size("s") > 0)
    # Arrays compare segment by segment: what the least and the largest share, all share.
    ends = split.agg(F.min("s").alias("lo"), F.max("s").alias("hi"), F.min(F.size("s")).alias("least"), F.max("back").alias("back"))
    differ = F.filter(F.sequence(F.lit(1), "least"), lambda i: (i == F.col("least")) | (F.get("lo", i - 1) != F.get("hi", i - 1)))
    ends = ends.select((F.element_at(differ, 1) - 1).alias("common"), F.when(F.col("back"), "\\").otherwise("/").alias("sep"))
    joined = lambda parts: F.replace(F.array_join(parts, "/"), F.lit("/"), F.col("sep"))
    each = split.crossJoin(F.broadcast(ends)).select(  # one row
        F.explode(F.transform(F.sequence("common", F.size("s")), lambda n: F.struct(
            joined(F.slice("s", 1, n)).alias("path"), F.when(n > 0, joined(F.slice("s", 1, n - 1))).alias("parent_path"),
            F.when(n > 0, F.get("s", n - 1)).otherwise(F.lit("results")).alias("name"), (n - F.col("common")).alias("depth"),
        ))).alias("n"), "bytes",
    )
    tree = each.groupBy("n.path", "n.parent_path", "n.name", "n.depth").agg(F.sum("bytes").alias("bytes"))
    return tree.withColumn("parent_path", F.when(F.col("depth") > 0, F.col("parent_path")))


def stale_bytes(bands: DataFrame) -> DataFrame:
    """Bytes of files of a year and more."""
    return bands.agg(F.coalesce(F.sum(F.when(F.col("band").isin("1to2yr", "gt2yr"), F.col("total_bytes"))), F.lit(0)).alias("stale_bytes"))


def tail_aggregate(rows: DataFrame, keep: int = 24) -> DataFrame:
    """The largest rows (name, value), the rest as one row."""
    order = Window.orderBy(F.desc("value"), "name")
    top = rows.orderBy(F.desc("value"), "name").limit(keep)
    ranked = top.withColumn("rank", F.row_number().over(order))  # over ``keep`` rows
    rest = rows.join(top.select("name"), "name", "left_anti").agg(F.count(F.lit(1)).alias("tiles"), F.sum("value").alias("value")).filter("tiles > 0")
    return ranked.select("rank", "name", F.lit(1).cast("long").alias("tiles"), F.greatest(F.lit(1), "value").alias("value")).unionByName(
        rest.select(F.lit(keep + 1).alias("rank"), F.lit("(others)").alias("name"), "tiles", F.greatest(F.lit(1), "value").alias("value"))
    )


def icicle(tree: DataFrame, width: float = 1.0, most_depth: int = 6) -> DataFrame:
    """Each node's place (x, w) in its level: children part their parent's width by bytes, largest first.

    ``tree`` is of :func:`prefix_tree`. A node's own start is what its larger
    siblings take, cumulated over ranges of the order, so a folder with very many children is many
    tasks; its place is the sum of starts up its ancestors.
    """
    rows = tree.filter((F.col("depth") <= most_depth) & (F.col("bytes") > 0))
    keyed = rows.withColumns({"_parent": F.coalesce("parent_path", F.lit("")), "_least": -F.col("bytes")})
    rows = shared.written(ordered.before_in_group(keyed, ["_parent"], ["_least", "path"], {"start": F.col("bytes")}).drop("_parent", "_least"), "icicle")
    root = F.broadcast(tree.filter("depth = 0").select(F.col("bytes").alias("all")))  # one row
    up = rows.select("path", F.explode(paths.ancestors(F.col("path"))).alias("on"))
    starts = up.join(rows.filter("depth > 0").select(F.col("path").alias("on"), "start"), "on").groupBy("path").agg(F.sum("start").alias("at"))
    share = lambda c: width * c / F.col("all")
    return rows.join(starts, "path", "left").crossJoin(root).select("path", "depth", "bytes", share(F.coalesce("at", F.lit(0))).alias("x"), share(F.col("bytes")).alias("w"))


def largest_children(rows: DataFrame, keep: int) -> DataFrame:
    """Each parent's largest children (parent_path, name, value), the rest of them as one named (others)."""
    order = Window.partitionBy("parent_path").orderBy(F.desc("value"), "name")
    top = rows.filter("value > 0").withColumn("r", F.row_number().over(order)).filter(F.col("r") <= keep).drop("r")
    sums = lambda df, name: df.groupBy("parent_path").agg(F.sum("value").alias(name))
    rest = sums(rows.filter("value > 0"), "all").join(sums(top, "some"), "parent_path").select("parent_path", F.lit("(others)").alias("name"), (F.col("all") - F.col("some")).alias("value"))
    return top.select("parent_path", "name", "value").unionByName(rest.filter("value > 0"))


def squarify(rows: DataFrame, width: float = 100.0, height: float = 100.0, keep: int = 200) -> DataFrame:
    """Squarified treemap tiles (x, y, w, h) of each parent's children.

    The layout is greedy and sequential, so a group is bounded first: the ``keep``
    largest children, and the others as one tile.
    """
    import pandas as pd

    rows = largest_children(rows, keep)

    def layout(group: pd.DataFrame) -> pd.DataFrame:
        group = group[group["value"] > 0].sort_values(["value", "name"], ascending=[False, True])
        total, out = float(group["value"].sum()), []
        x, y, w, h = 0.0, 0.0, width, height
        todo = [(n, v / total * width * height) for n, v in zip(group["name"], group["value"], strict=True)]
        while todo:
            side, row, area, worst = min(w, h), [], 0.0, float("inf")
            for name, a in todo:
                grown = area + a
                sizes = (row[0][1] if row else a, a)  # tiles come largest first
                ratio = max(max(side * side * s / grown**2, grown**2 / (side * side * s)) for s in sizes)
                if row and ratio > worst:
                    break
                row.append((name, a))
                area, worst = grown, ratio
            thick, at = area / side, 0.0
            for name, a in row:
                length = a / thick
                out.append((name, x, y + at, thick, length) if w >= h else (name, x + at, y, length, thick))
                at += length
            x, y, w, h = (x + thick, y, w - thick, h) if w >= h else (x, y + thick, w, h - thick)
            todo = todo[len(row) :]
        frame = pd.DataFrame(out, columns=["name", "x", "y", "w", "h"])
        frame.insert(0, "parent_path", rows_parent(group))
        return frame

    def rows_parent(group: pd.DataFrame) -> str:
        return group["parent_path"].iloc[0] if len(group) else ""

    return rows.groupBy("parent_path").applyInPandas(layout, "parent_path string, name string, x double, y double, w double, h double")
