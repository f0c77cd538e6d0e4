"""Operator 1: mixing sources to target weights by Poisson replication.

Each source gets a mean repetition rate so that its expected share of the
output is its target weight. Every row draws its own count from a Poisson
distribution with that mean: a hash of the row and the seed gives a uniform
number, which is inverted through the distribution function, tabled once for
each source. Rows are exploded by their count and dealt over the cluster by a
second hash, in its order.

Only DataFrame functions are used. One shuffle counts rows per source (with
map-side partial sums) and one deals out the result; the counts join back by
source, a table of one row per source whose join strategy is left to the
size-checking planner.

Defined results: a null source is a source of its own (``weights[None]``); a
source absent from ``weights`` takes ``default_weight``; a weight of 0 drops a
source. Null or empty texts are rows like any other. Repeated rows with equal
``doc_id`` draw equal counts; a null ``doc_id`` draws by its text. No rows give
no rows. Extra columns pass through, whatever their names; the added columns
overwrite columns of the same names, and without ``describe`` none is added.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm import store

#: Hex digits of a hash that make a uniform number: 52 bits, exact in a double.
HEX, BITS = 13, 52
ADDED = ("rate", "copies", "replica", "shuffle_key")


def _uniform(seed: str, key: Column) -> Column:
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key).cast("binary")), 1, HEX)
    return (F.conv(digits, 16, 10).cast("long").cast("double") + F.lit(0.5)) / F.lit(float(2**BITS))


def poisson_steps(rate: Column) -> Column:
    """Values of the distribution function of Poisson(rate) at 0, 1, ... as far as a uniform number can pass them.

    The sum ends at rate + 12 sqrt(rate) + 60, beyond which no 52-bit uniform
    number reaches. Rates over 500 are split into equal parts by the caller.
    """
    last = F.ceil(rate + 12.0 * F.sqrt(rate) + 60.0).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("cdf"), F.array(F.exp(-rate)).alias("all"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k.cast("double")
        return F.struct(p.alias("p"), (acc["cdf"] + p).alias("cdf"), F.array_append(acc["all"], acc["cdf"] + p).alias("all"))

    highest = (2.0**BITS - 0.5) / 2.0**BITS
    return F.filter(F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["all"]), lambda c: c < highest)


def poisson_count(steps: Column, uniform: Column) -> Column:
    """Smallest k with P(Poisson <= k) >= uniform, from the distribution function's ``steps``."""
    return F.size(F.filter(steps, lambda c: c < uniform))


def source_rates(
    docs: DataFrame,
    weights: Mapping[str | None, float] | None,
    default_weight: float,
    total: float | None,
    source: str = "source",
) -> DataFrame:
    """One row per source: (src, rate, parts, steps), the rate being its mean repetition for ``total`` expected output rows.

    A draw is the sum of ``parts`` draws of equal rates, whose distribution function is ``steps``.
    """
    if weights and any(w < 0 for w in weights.values()) or default_weight < 0:
        raise ValueError("weights must not be negative")
    counts = docs.groupBy(F.col(f"`{source}`").alias("src")).agg(F.count(F.lit(1)).alias("rows"))
    weight = F.lit(float(default_weight))
    for name, w in (weights or {}).items():
        weight = F.when(F.col("src").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(weight)
    counts = counts.withColumn("weight", weight)
    sums = counts.agg(F.sum("weight").alias("all"), F.sum("rows").alias("n"))
    target = F.col("n").cast("double") if total is None else F.lit(float(total))
    share = F.when(F.col("all") > 0, F.col("weight") / F.col("all")).otherwise(0.0)
    rates = counts.crossJoin(F.broadcast(sums)).select("src", (target * share / F.col("rows")).alias("rate"))  # one row of totals
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / 500.0).cast("int"))
    return rates.withColumn("parts", parts).withColumn("steps", poisson_steps(F.col("rate") / F.col("parts")))


def mix_sources(
    docs: DataFrame,
    weights: Mapping[str | None, float] | None = None,
    default_weight: float = 1.0,
    total: float | None = None,
    seed: str = "mix",
    source: str = "source",
    doc_id: str = "doc_id",
    text: str = "text",
    partitions: int | None = None,
    describe: bool = True,
) -> DataFrame:
    """Replicate rows so that sources meet their target weights, in globally shuffled order.

    Adds ``rate`` (the source's mean), ``copies`` (the row's draw), ``replica``
    (0 to copies - 1) and ``shuffle_key`` (the hash that orders the output);
    without ``describe`` nothing is added and every column stays as it is.
    """
    # Written, so that the planner knows the size of the table when it chooses the join.
    rates = store.written(source_rates(docs, weights, default_weight, total, source), "rates")
    key = F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.concat(F.lit("t"), F.md5(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary"))))
    # The row travels as one struct: no column of ours can meet one of its own.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{source}`").alias("own"), key.alias("key"))
    rows = rows.join(rates, rows["own"].eqNullSafe(rates["src"]), "left")
    draws = F.transform(
        F.sequence(F.lit(1), F.col("parts")),
        lambda i: poisson_count(F.col("steps"), _uniform(seed, F.concat(F.col("key"), F.lit("#"), i.cast("string")))),
    )
    copies = F.aggregate(draws, F.lit(0), lambda a, x: a + x)
    drawn = rows.select("row", "key", "rate", copies.alias("copies")).filter(F.col("copies") > 0)
    copied = drawn.withColumn("replica", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    order = F.md5(F.concat(F.lit(f"{seed}/order:"), F.col("key"), F.lit("#"), F.col("replica").cast("string")).cast("binary"))
    dealt = copied.withColumn("shuffle_key", order).drop("key")
    # The key is a uniform hash: dealing by it needs no sampling pass, as a range would.
    n = [partitions] if partitions else []
    dealt = dealt.repartition(*n, "shuffle_key").sortWithinPartitions("shuffle_key", "replica")
    kept = [c for c in docs.columns if not describe or c not in ADDED]
    return dealt.select(*[F.col("row")[c].alias(c) for c in kept], *(ADDED if describe else ()))


def oracle(weights: Mapping[str, float], default_weight: float = 1.0, seed: str = "mix") -> str:
    """The same rows in DuckDB SQL (rates up to 500, weights by source name)."""
    cases = " ".join(f"WHEN '{k}' THEN {float(v)}::DOUBLE" for k, v in weights.items())
    weight = f"CASE source {cases} ELSE {float(default_weight)}::DOUBLE END" if weights else f"{float(default_weight)}::DOUBLE"
    uniform = f"(('0x' || substr(md5('{seed}:' || doc_id || '#1'), 1, {HEX}))::BIGINT::DOUBLE + 0.5) / {float(2**BITS)}"
    return f"""
WITH RECURSIVE c AS (SELECT source, count(*) AS n, {weight} AS w FROM documents GROUP BY source),
r AS (SELECT source, (SELECT sum(n) FROM c)::DOUBLE * (w / (SELECT sum(w) FROM c)) / n AS rate FROM c),
d AS (SELECT documents.*, rate, {uniform} AS u FROM documents JOIN r ON documents.source IS NOT DISTINCT FROM r.source),
walk(source, rate, k, p, cdf) AS (
  SELECT source, rate, 0, exp(-rate), exp(-rate) FROM r
  UNION ALL SELECT source, rate, k + 1, p * rate / (k + 1), cdf + p * rate / (k + 1) FROM walk WHERE k < ceil(rate + 12 * sqrt(rate) + 60)),
n AS (SELECT d.*, (SELECT count(*) FROM walk w WHERE w.source IS NOT DISTINCT FROM d.source AND w.cdf < d.u)::INTEGER AS copies FROM d)
SELECT doc_id, source, text, rate, copies, replica::INTEGER AS replica,
  md5('{seed}/order:' || doc_id || '#' || replica) AS shuffle_key
FROM (SELECT *, unnest(range(copies)) AS replica FROM n WHERE copies > 0)
""".strip()
