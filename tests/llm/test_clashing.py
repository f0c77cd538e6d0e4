"""Columns whose names operators use inside, or add."""

from collections import Counter

import pytest

import corpus_pipeline
from tests.llm.conftest import CLASHING, kept_whole
from shelfmark.llm import decontaminate, jaccard, langid, licenses, mixing, sharding, toxicity


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(1, "same row twice"), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_keep_columns_and_take_empty_tables(spark, clashing, sf_dir, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, clashing, sf_dir)
    if name != "shards":
        assert out.columns == clashing.columns
        rows = out.collect()
        assert rows and kept_whole(rows)
    else:
        assert out.columns == [c for c in clashing.columns if c not in ("shard", "slot")] + ["shard", "slot"]
        assert out.count() == clashing.count()
    assert stage(spark, clashing.limit(0), sf_dir).count() == 0


def test_language_stage_without_labels_is_an_error(spark, sf_dir):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError):
        corpus_pipeline.language(spark, docs, sf_dir)


def test_replicas_are_dealt_apart(spark, tmp_path):
    spark.range(300).selectExpr("id AS doc_id", "'t' AS text", "'en' AS lang", "'a' AS source", "1L AS n_chars").write.parquet(f"{tmp_path}/one")
    docs = spark.read.parquet(f"{tmp_path}/one")
    docs.union(docs).union(docs).repartition(3, "doc_id").write.parquet(f"{tmp_path}/three")
    rows = corpus_pipeline.shards(spark, spark.read.parquet(f"{tmp_path}/three"), "").orderBy("shard", "slot").collect()
    together = sum(a.doc_id == b.doc_id for a, b in zip(rows, rows[1:], strict=False))
    assert len(rows) == 900 and together < 30
    again = corpus_pipeline.shards(spark, spark.read.parquet(f"{tmp_path}/three"), "").orderBy("shard", "slot").collect()
    assert [r.doc_id for r in rows] == [r.doc_id for r in again]


def test_operators_with_clashing_columns(spark, clashing, none, sf_dir):
    n = clashing.count()
    mixed = mixing.mix_sources(clashing, {"a": 2.0})
    assert Counter(mixed.columns) == Counter([c for c in clashing.columns if c not in mixing.ADDED] + list(mixing.ADDED))
    assert {r._key for r in mixed.collect()} == {"keep _key"}
    placed = sharding.interleave(clashing, 8, order=("doc_id", "text"), bucket_rows=5).collect()
    assert sorted(r.position for r in placed) == list(range(n)) and {r["before"] for r in placed} == {"keep before"}
    assert jaccard.classify(clashing).count() == n
    assert kept_whole(jaccard.deduplicate(clashing).collect())
    model = langid.fit(clashing)
    assert {r.row for r in langid.predict(clashing, model).collect()} == {"keep row"}
    assert licenses.scan(clashing).count() == n
    assert decontaminate.scan(clashing, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).count() == 1
    assert toxicity.score(clashing, toxicity.Model(0.1)).count() == n
    assert CLASHING
