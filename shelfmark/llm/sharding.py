"""Operator 6: shards by proportional stratified interleaving.

Rows are ranked within their source in an order shuffled by a seeded hash. Row r
of a source with n rows gets the fraction (2r - 1) / 2n; all rows sort by that
fraction, so that every stretch of the order holds the sources in proportion.
The order is cut into equal stretches: shard = floor(position * shards / rows).
Row counts of shards differ by at most one (law ``rows``).

Neither rank is a window over a whole source or over all rows. Both count rows by
bucket (of the hash within a source, then of the fraction over all), sum the
counts before each bucket, and number rows inside a bucket only. A source that
holds a third of all rows is so dealt over all buckets, and a bucket holds
``bucket_rows`` rows on average whatever the input. Only DataFrame functions are
used.

Defined results: a null source is a stratum of its own; null and empty texts and
null ids are rows like any other; repeated rows (equal in all order columns)
take neighbouring ranks in no set order, which leaves equal results; no rows
give no rows. Extra columns pass through, whatever their names; added columns
overwrite the same names.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LAW = "rows"
#: Average rows of a bucket.
BUCKET_ROWS = 2_000
#: Buckets that are cumulated in one window.
RUN = 1_024
DIGITS = 8  # hex digits of the hash that choose a bucket


def file_position(rows: DataFrame) -> DataFrame | None:
    """(row, place): each row of a Parquet table and the number of its file and its place there; None for other tables.

    The place tells replicas of one row apart, the same in every attempt of a task.
    """
    part = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1)
    try:
        return rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), F.concat_ws(":", part, F.col("_metadata.row_index").cast("string")).alias("place"))
    except AnalysisException:
        return None


def _before(counts: DataFrame, by: list[str], key: str) -> DataFrame:
    """(by, key, before): for each count ``c`` the sum of those of smaller keys, within a value of ``by``.

    In two levels: runs of RUN keys are cumulated each on their own, and their totals, a row a run, together.
    """
    run = F.floor(F.col(key) / RUN).alias("run")
    earlier = Window.partitionBy(*by, "run").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    runs = counts.groupBy(*by, run).agg(F.sum("c").alias("c"))
    starts = runs.select(*by, "run", F.coalesce(F.sum("c").over(Window.partitionBy(*by).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    within = counts.select(*by, key, run, "c").withColumn("within", F.coalesce(F.sum("c").over(earlier), F.lit(0)))
    return within.join(starts, [*by, "run"]).select(*by, key, (F.col("start") + F.col("within")).alias("before"))


def interleave(
    rows: DataFrame,
    shards: int = 8,
    source: str = "source",
    order: tuple[str, ...] = ("doc_id",),
    seed: str = "shard",
    bucket_rows: int = BUCKET_ROWS,
    spread_repeats: bool = False,
) -> DataFrame:
    """Add ``position`` (from 0, over all rows), ``shard`` and ``slot`` (from 0 in its shard).

    ``order`` names the columns whose text is hashed and then breaks ties. With
    ``spread_repeats``, repeated rows of a Parquet table are hashed by their place
    in it too, so they are dealt apart.
    """
    kept = [c for c in rows.columns if c not in ("position", "shard", "slot")]
    # The row travels as one struct: no column of ours can meet one of its own.
    packed = file_position(rows) if spread_repeats else None
    tell: list[Column] = [F.col("place")] if packed is not None else []
    if packed is None:
        packed = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"))
    ties = [F.col("row")[c] for c in order]
    hashed = F.md5(F.concat_ws("|", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("")) for c in [*ties, *tell]]).cast("binary"))
    stratum = F.coalesce(F.concat(F.lit("s"), F.col("row")[source].cast("string")), F.lit("n"))
    total = rows.count()
    buckets = max(1, -(-total // bucket_rows))
    span = 16**DIGITS
    fine = F.floor(F.conv(F.substring(hashed, 1, DIGITS), 16, 10).cast("long") * F.lit(buckets) / F.lit(span)).cast("int")
    base = packed.select("row", stratum.alias("s"), hashed.alias("h"), fine.alias("b"), F.struct(*[c.alias(f"t{i}") for i, c in enumerate([*ties, *tell])]).alias("t"))

    counts = base.groupBy("s", "b").agg(F.count(F.lit(1)).alias("c"))
    starts = _before(counts, ["s"], "b").join(counts.groupBy("s").agg(F.sum("c").alias("n")), "s")
    inside = Window.partitionBy("s", "b").orderBy("h", "t")
    ranked = base.join(starts, ["s", "b"], "left").withColumn("r", F.col("before") + F.row_number().over(inside))
    # Fraction (2r - 1) / 2n; its bucket is floor(fraction * buckets), in whole numbers.
    ranked = ranked.select("row", "s", "r", "n", F.expr(f"CAST(((2 * r - 1) * {buckets}L) DIV (2 * n) AS INT)").alias("x"))

    sizes = ranked.groupBy("x").agg(F.count(F.lit(1)).alias("c"))
    borders = _before(sizes, [], "x")
    across = Window.partitionBy("x").orderBy((2 * F.col("r") - 1).cast("double") / (2 * F.col("n")).cast("double"), "s", "r")
    position = (F.col("before") + F.row_number().over(across) - 1).cast("long")
    placed = ranked.join(borders, "x", "left").select("row", position.alias("position"))
    shard = F.expr(f"CAST((position * {shards}) DIV {max(total, 1)}L AS INT)")
    start = F.expr(f"(shard * {max(total, 1)}L + {shards - 1}) DIV {shards}")
    placed = placed.withColumn("shard", shard).withColumn("slot", F.col("position") - start)
    return placed.select(*[F.col("row")[c].alias(c) for c in kept], "position", "shard", "slot")


def crc32_sql(table: str, key: str, text: str) -> str:
    """DuckDB SQL: (key, crc32) of every row of ``table``, by four bits at a time over the UTF-8 bytes (null text: null)."""
    half = list(range(16))
    for _ in range(4):
        half = [(v >> 1) ^ (0xEDB88320 if v & 1 else 0) for v in half]
    t = "[" + ", ".join(map(str, half)) + "]::UBIGINT[]"
    four = lambda x: f"xor({x} >> 4, ({t})[({x} & 15)::INT + 1])"
    return f"""
SELECT {key}, CASE WHEN {text} IS NOT NULL THEN xor(list_reduce(
  list_transform(range(1, octet_length(encode({text})) + 1), lambda i: ('0x' || substr(hex(encode({text})), 2 * i - 1, 2))::UBIGINT),
  lambda c, b: {four(four("xor(c, b)"))}, 4294967295::UBIGINT), 4294967295::UBIGINT)::BIGINT END AS text_crc32 FROM {table}
""".strip()


def oracle(shards: int = 8, seed: str = "shard") -> str:
    """The query over ``documents`` in DuckDB SQL, by whole-table windows in place of buckets."""
    return f"""
WITH c AS ({crc32_sql("documents", "doc_id", "text")}),
d AS (SELECT doc_id, source, octet_length(encode(coalesce(text, '')))::BIGINT + 1 AS size, text_crc32 FROM documents JOIN c USING (doc_id)),
h AS (SELECT *, coalesce('s' || source, 'n') AS s,
      md5(concat_ws('|', '{seed}', coalesce(doc_id::VARCHAR, ''), coalesce(text_crc32::VARCHAR, ''), coalesce(size::VARCHAR, ''))) AS h FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY h, doc_id, text_crc32, size) AS r, count(*) OVER (PARTITION BY s) AS n, count(*) OVER () AS total FROM h),
p AS (SELECT *, row_number() OVER (ORDER BY (2 * r - 1)::DOUBLE / (2 * n)::DOUBLE, s, r) - 1 AS position FROM r),
q AS (SELECT *, ((position * {shards}) // total)::INTEGER AS shard FROM p)
SELECT doc_id, size, text_crc32, '{LAW}' AS law, shard, position - (shard * total + {shards - 1}) // {shards} AS slot, NULL::INTEGER AS grown_shard, source FROM q
""".strip()
