"""A corpus pipeline over ``documents``: language, near duplicates, test items, mixture, shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's ``docs``; all but the last return
the columns of ``documents``. Every stage takes empty tables, nulls in any column
and further columns of any name, which it returns unchanged.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import decontaminate, jaccard, langid, mixing, sharding, store
from shelfmark.llm.queries import MIX_WEIGHTS, SHARDS

#: Near duplicates in the pipeline: shingles of five words, similarity 0.8 or more.
WIDTH, THRESHOLD = 5, 0.8
#: A text is rejected as ambiguous only if its two best languages are this close.
AMBIGUOUS_MARGIN = 0.01


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without a language (null, no letter) and those ambiguous between two.

    No rows give no rows. Rows of which none has a language to learn from are an error.
    """
    model = langid.fit(docs)
    if model is None and docs.limit(1).count():
        raise ValueError("no row has a text and a lang: there is no language to learn")
    return langid.keep_known(docs, model, ambiguous_margin=AMBIGUOUS_MARGIN)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate component: the smallest doc_id, null last.

    Rows without words stay, as they are; repeated rows are copies of one another.
    """
    return jaccard.deduplicate(docs, WIDTH, THRESHOLD)


def test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that contain a test item; null texts contain none, and no items drop nothing."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replicate documents to the target weights of their sources; a null source is one of its own."""
    return mixing.mix_sources(docs, MIX_WEIGHTS, describe=False)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place every row in a shard and slot, replicas of one row apart; a column of these names is replaced."""
    kept = [c for c in docs.columns if c not in ("shard", "slot")]
    placed = sharding.interleave(docs, SHARDS, order=("doc_id", "n_chars", "lang"), spread_repeats=True)
    return placed.select(*kept, "shard", "slot")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("test_items", test_items),
    ("mixture", mixture),
    ("shards", shards),
]
#: The language stage is a trained model: SQL can't express it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = f"{store.shared_root(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        scratch = store.Scratch()
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{root}/{name}")
        scratch.clear_all()  # what the stage wrote for itself
        docs = spark.read.schema(out.schema).parquet(f"{root}/{name}")
    return docs


def queries() -> dict:
    """The pipeline as a query."""
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    """No oracle: see ORACLE_SQL."""
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
