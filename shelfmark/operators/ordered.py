"""Cumulative sums and places over a total order, without a window over all rows.

Rows are dealt to ranges of the order, each row with the number of its range, and
written: the ranges are sampled, so they must not be drawn again. A range is summed
on its own; the totals of the ranges (a row each) are cumulated on the driver and
added to the sums inside a range. No task sees more than one range, so an order
should tell rows apart: rows equal in it lie in one range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.sources import shared

ROWS_PER_RANGE = 500_000


def ranged(rows: DataFrame, order: Sequence[str | Column], ranges: int | None = None) -> DataFrame:
    """``rows`` written with ``_range``, the number of their range of the order."""
    count = ranges or max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return shared.written(rows.repartitionByRange(count, *order).withColumn("_range", F.spark_partition_id()), "ranged")


def before(rows: DataFrame, order: Sequence[str], values: dict[str, Column], ranges: int | None = None) -> DataFrame:
    """``rows`` with, for each name of ``values``, the sum of that value over all rows earlier in the order (0 for the first).

    ``order`` are column names, ascending; the sums are of the values' type after ``sum``.
    """
    spread = ranged(rows.withColumns({f"_{n}": v for n, v in values.items()}), order, ranges)
    names = list(values)
    sums = [F.sum(f"_{n}").alias(n) for n in names]
    totals = sorted(spread.groupBy("_range").agg(*sums).collect())  # a row for each range
    running, starts = dict.fromkeys(names, 0), []
    for r in totals:
        starts.append((r["_range"], *(running[n] for n in names)))
        running = {n: running[n] + (r[n] or 0) for n in names}
    kinds = {f.name: f.dataType.simpleString() for f in spread.groupBy("_range").agg(*sums).schema}
    first = rows.sparkSession.createDataFrame(starts, "_range int, " + ", ".join(f"_start_{n} {kinds[n]}" for n in names))
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = spread.withColumns({n: F.coalesce(F.sum(f"_{n}").over(within), F.lit(0)) for n in names}).join(F.broadcast(first), "_range")
    return summed.select(*rows.columns, *[(F.col(n) + F.col(f"_start_{n}")).alias(n) for n in names])


def before_in_group(rows: DataFrame, group: Sequence[str], order: Sequence[str], values: dict[str, Column], ranges: int | None = None) -> DataFrame:
    """As :func:`before`, but over the rows of the same ``group`` only; a group may lie in many ranges.

    ``values`` are not negative, so a group's first row has its least sum.
    """
    summed = before(rows, [*group, *order], values, ranges)
    least = summed.groupBy(*group).agg(*[F.min(n).alias(f"_least_{n}") for n in values])
    out = summed.join(least, list(group))
    return out.select(*rows.columns, *[(F.col(n) - F.col(f"_least_{n}")).alias(n) for n in values])


def packed(rows: DataFrame, weight: Column, most: int, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``pack``: consecutive rows of about ``most`` total weight share one; a heavier row has one of its own.

    A row goes to the pack in which its middle lies, so packs hold under twice ``most``
    unless one row alone is heavier.
    """
    at = before(rows.withColumn("_weight", weight.cast("long")), order, {"_at": F.col("_weight")})
    return at.withColumn("pack", F.expr(f"(_at + _weight DIV 2) DIV {int(most)}")).drop("_at", "_weight")
