"""Containment of folders by intervals.

Paths are sorted with the separators as the least characters, so a folder and all
below it are consecutive. Every folder sends two marks into one sort: itself, and
the first place after all that can lie below it. The number of folders before the
first mark is ``pre``, before the second ``stop``: a folder is below another if its
``pre`` lies in [pre, stop). Sums over folders before the marks give totals of whole trees by a
subtraction. Nothing is multiplied by levels, and no root collects all rows.

Both separators part names, as everywhere here; names that hold the control characters 1
to 3 are outside the model.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions import paths
from shelfmark.operators import ordered

#: What stands for ``/`` and ``\\`` in the order, and the first place after all below a folder.
BELOW, AFTER = "\x01\x02", "\x03"


def key(path: Column) -> Column:
    """Sort key of a path: a folder comes before all below it, and nothing else comes between."""
    return F.translate(path, "/\\", BELOW)


def with_ancestors(folders: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Distinct paths of ``folders`` (path) and of everything above them; within each value of ``by``, if given.

    In sorted order a path adds only those of its ancestors that the path before it
    doesn't have, so all are named once but for a few at the edges of ranges.
    """
    named = ordered.ranged(folders.select(*by, "path").filter("path <> ''").distinct().withColumn("_key", key(F.col("path"))), [*by, "_key"])
    last = F.lag("path").over(Window.partitionBy("_range", *by).orderBy("_key"))
    seen = F.coalesce(F.col("last"), F.lit(""))
    new = F.filter(paths.ancestors(F.col("path")), lambda a: ~((a == seen) | seen.startswith(F.concat(a, F.lit("/"))) | seen.startswith(F.concat(a, F.lit("\\")))))
    return named.withColumn("last", last).select(*by, F.explode(new).alias("path")).distinct()


def intervals(folders: DataFrame, by: Sequence[str] = (), **values: Column) -> DataFrame:
    """(path, pre, stop) of distinct ``folders`` (path, ...), and for each value its total over the folder and all below it.

    With ``by`` there is a tree for each of its values. Folders above the given ones count if they are among them (see :func:`with_ancestors`).
    """
    zero = {n: F.lit(0).cast("long") for n in values}
    own = folders.select(*by, "path", key(F.col("path")).alias("_key"), F.lit(1).cast("long").alias("_one"), *[F.coalesce(v.cast("long"), F.lit(0)).alias(n) for n, v in values.items()])
    stop = folders.select(*by, "path", F.concat(key(F.col("path")), F.lit(AFTER)).alias("_key"), F.lit(0).cast("long").alias("_one"), *[v.alias(n) for n, v in zero.items()])
    marks = own.union(stop).select(*by, "path", "_key", "_one", *[F.col(n).alias(f"_own_{n}") for n in values])
    sums = ordered.before(marks, [*by, "_key", "path", "_one"], {"place": F.col("_one"), **{n: F.col(f"_own_{n}") for n in values}})
    at = lambda c, one: F.max(F.when(F.col("_one") == one, F.col(c)))
    return sums.groupBy(*by, "path").agg(at("place", 1).alias("pre"), at("place", 0).alias("stop"), *[(at(n, 0) - at(n, 1)).alias(n) for n in values])


def dominant(files: DataFrame, value: str) -> DataFrame:
    """(path, value, bytes): per folder with all below it the value with most bytes; ties to the smallest."""
    direct = files.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("value"), F.col("folder_path").alias("path")).agg(F.sum(F.greatest(F.lit(0), "size")).alias("b"))
    rows = with_ancestors(direct, ["value"]).join(direct, ["value", "path"], "left")
    sums = intervals(rows, ["value"], bytes=F.col("b"))
    best = Window.partitionBy("path").orderBy(F.desc("bytes"), "value")
    return sums.withColumn("r", F.row_number().over(best)).filter("r = 1").select("path", "value", "bytes")


def totals(files: DataFrame, folders: DataFrame | None = None) -> DataFrame:
    """(path, total_files, total_bytes) of every folder with all below it.

    ``folders`` (path) are the catalog's folders; without them those of the files and all above.
    """
    direct = files.groupBy("folder_path").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b"))
    known = with_ancestors(direct.select(F.col("folder_path").alias("path")) if folders is None else folders)
    rows = known.join(direct.withColumnRenamed("folder_path", "path"), "path", "left")
    return intervals(rows, total_files=F.col("n"), total_bytes=F.col("b")).select("path", "total_files", "total_bytes")


def inside(rows: DataFrame, tree: DataFrame, folder: str) -> DataFrame:
    """Rows (pre, ...) in or below one folder of a tree (path, pre, stop): a range filter."""
    edge = tree.filter(F.col("path") == folder).select(F.col("pre").alias("_lo"), F.col("stop").alias("_hi"))
    return rows.join(F.broadcast(edge), (F.col("pre") >= F.col("_lo")) & (F.col("pre") < F.col("_hi"))).drop("_lo", "_hi")  # one row


def _open_at_edges(spread: DataFrame, outer: DataFrame | None = None) -> DataFrame:
    """(_range, path, pre, stop): folders (of ``outer``, if given) of earlier ranges that are still open where a range begins."""
    edges = spread.groupBy("_range").agg(F.min("pre").alias("edge"))  # a row for each range
    at = [(r["_range"], r["edge"]) for r in sorted(edges.collect())]
    starts = F.array(*[F.struct(F.lit(n).alias("_range"), F.lit(e).cast("long").alias("edge")) for n, e in at])
    crossed = F.filter(starts, lambda s: (s["edge"] > F.col("pre")) & (s["edge"] < F.col("stop")))
    return (spread if outer is None else outer).filter("stop > pre + 1").select(F.explode(crossed).alias("s"), "path", "pre", "stop").select("s._range", "path", "pre", "stop")


def enclosing(some: DataFrame) -> DataFrame:
    """(path, parent_path): for each folder (path, pre, stop) the nearest other one of the set above it, or null.

    A range of folders in order is one walk with a stack of open folders; it starts with those still open there.
    """
    import pandas as pd

    spread = ordered.ranged(some.select("path", "pre", "stop"), ["pre"])
    if not spread.limit(1).count():
        return spread.select("path", F.lit(None).cast("string").alias("parent_path"))
    carried = _open_at_edges(spread)
    rows = spread.select("_range", "path", "pre", "stop", F.lit(True).alias("own")).union(carried.select("_range", "path", "pre", "stop", F.lit(False).alias("own")))

    def walk(part: pd.DataFrame) -> pd.DataFrame:
        out, stack = [], []
        for path, _, stop, own, pre in part.sort_values("pre")[["path", "_range", "stop", "own", "pre"]].itertuples(index=False):
            while stack and stack[-1][1] <= pre:
                stack.pop()
            if own:
                out.append((path, stack[-1][0] if stack else None))
            stack.append((path, stop))
        return pd.DataFrame(out, columns=["path", "parent_path"])

    return rows.groupBy("_range").applyInPandas(walk, "path string, parent_path string")


def containing(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """(path, above): for each of ``inner`` (path, pre) all of ``outer`` (path, pre, stop) that it is or lies below.

    Both are of one tree, each path once. Ranges of the order are walked with the stack of open
    folders, so a folder that holds everything is open in every range and no task's own.
    """
    import pandas as pd

    marks = outer.select("path", "pre", "stop", F.lit(0).alias("role")).union(inner.select("path", "pre", F.lit(None).cast("long"), F.lit(1)))
    spread = ordered.ranged(marks, ["pre"])
    if not spread.limit(1).count():
        return spread.select("path", F.col("path").alias("above"))
    carried = _open_at_edges(spread, outer)
    rows = spread.select("_range", "path", "pre", "stop", "role").union(carried.select("_range", "path", "pre", "stop", F.lit(0)))

    def walk(part: pd.DataFrame) -> pd.DataFrame:
        out, stack = [], []
        for path, pre, stop, role in part.sort_values(["pre", "role"])[["path", "pre", "stop", "role"]].itertuples(index=False):
            while stack and stack[-1][1] <= pre:
                stack.pop()
            if role:
                out += [(path, above) for above, _ in stack]
            else:
                stack.append((path, stop))
        return pd.DataFrame(out, columns=["path", "above"])

    return rows.groupBy("_range").applyInPandas(walk, "path string, above string")


def outermost(some: DataFrame) -> DataFrame:
    """Folders (path, pre, stop) that lie below no other of the set (F16)."""
    return enclosing(some).filter("parent_path IS NULL").select("path")
