"""The operators' queries, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import centroids, decontaminate, integers, jaccard, langid, licenses, mixing, negatives, neighbours, rules, sharding, toxicity, urlfilter, wrappers

#: Target weights of the mixture: the large crawl source at twice the weight of any other.
MIX_WEIGHTS = {"src0": 2.0}
SHARDS = 8
#: The rules that urls are judged by.
URL_RULES = [
    urlfilter.Rule("block", "com", "/en/"),
    urlfilter.Rule("allow", "example.com", "/en/7"),
    urlfilter.Rule("allow", "net", "/de/"),
    urlfilter.Rule("block", "example.net", "/de/8"),
    urlfilter.Rule("block", "org", "/es/"),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixture of all documents by Poisson replication."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix_sources(docs, MIX_WEIGHTS)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of all documents: row law, every shard in the mixture's proportions."""
    docs = _table(spark, sf_dir, "documents")
    text = F.col("text").cast("binary")
    rows = docs.select(
        "doc_id", "source",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    out = sharding.interleave(rows, SHARDS, order=("doc_id", "text_crc32", "size"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit(sharding.LAW).alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "source",
    )


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return jaccard.classify(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of all documents."""
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all urls."""
    return urlfilter.judge(_table(spark, sf_dir, "pages"), URL_RULES)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents, learnt from three quarters of the labelled ones."""
    docs = _table(spark, sf_dir, "documents")
    held_out = langid.fold(F.col("doc_id"), 4) == 2
    model = langid.fit(docs.filter(~held_out))
    out = langid.predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learnt from four fifths of the labelled ones."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = langid.fold(F.col("doc_id"), 5) == 0
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels").filter(~held_out))
    out = toxicity.score(docs, model)
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty nearest of every vector whose id 20 divides."""
    vectors = neighbours.usable(_table(spark, sf_dir, "embeddings"))
    return neighbours.search(vectors, vectors.filter(F.col("vec_id") % 20 == 0))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return wrappers.main_text(_table(spark, sf_dir, "pages"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test items that any document contains."""
    return decontaminate.scan(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every vector whose id 50 divides."""
    rows = _table(spark, sf_dir, "embeddings")
    vectors = integers.whole(rows, "vec_id", "label")
    vectors = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.mine(vectors, F.col("vec_id") % 50 == 0)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents, learnt from two thirds of the labelled ones."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = langid.fold(F.col("doc_id"), 3) == 1
    model = rules.fit(docs, _table(spark, sf_dir, "labels").filter(~held_out))
    out = rules.score(docs, model)
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty clusters of all vectors."""
    return centroids.cluster(integers.whole(_table(spark, sf_dir, "embeddings"), "vec_id", dimensions=centroids.DIMENSIONS))


def queries() -> dict:
    """Query by name."""
    return {
        "op1_poisson_mixture": op1,
        "op2_signature_trees": op2,
        "op3_license_scan": op3,
        "op4_link_propagation": op4,
        "op5_output_codes": op5,
        "op6_stratified_shards": op6,
        "op7_recurrent_toxicity": op7,
        "op8_learned_partitions": op8,
        "op9_page_wrappers": op9,
        "op10_containment_search": op10,
        "op11_voronoi_negatives": op11,
        "op12_rule_ensemble": op12,
        "op13_hamerly_centroids": op13,
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by query name."""
    return {
        "op1_poisson_mixture": mixing.oracle(MIX_WEIGHTS),
        "op2_signature_trees": jaccard.oracle(),
        "op3_license_scan": licenses.oracle(),
        "op6_stratified_shards": sharding.oracle(SHARDS),
        "op10_containment_search": decontaminate.oracle(),
        "op11_voronoi_negatives": negatives.oracle(),
        "op13_hamerly_centroids": centroids.oracle(),
    }
