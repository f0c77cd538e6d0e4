from collections import Counter

import corpus_pipeline
from shelfmark.llm import queries


def test_stages_on_messy_rows(spark, messy, tmp_path):
    docs = messy.select("doc_id", "text", "lang", "source", "n_chars")
    spark.createDataFrame([(1, "same row twice"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        if name != "shards":
            assert out.columns == docs.columns
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        sizes.append(docs.count())
        if name == "test_items":
            kept = Counter(r.doc_id for r in docs.collect())
            assert kept[100] == 1 and not kept[101] and not kept[103] and kept[110] == 1
    assert sizes[1] < sizes[0] and sizes[2] < sizes[1] and sizes[3] < sizes[2] and sizes[5] == sizes[4]
    assert set(docs.columns) == {"doc_id", "text", "lang", "source", "n_chars", "shard", "slot"}


def test_names():
    assert [int(n[2:].split("_")[0]) for n in queries.queries()] == list(range(1, 14))
    assert set(queries.oracle_sql()) <= set(queries.queries())
    assert list(corpus_pipeline.queries()) == ["pipeline"]
