"""The knowledge base follows its tables."""

import shutil

from pyspark.sql import functions as F

from shelfmark.plans import catalog
from shelfmark.sources import knowledge, shared

SF = "/root/testdata/sf0.001"


def test_changed_tables_give_new_candidates(spark, tmp_path):
    shutil.copy(f"{SF}/documents.parquet", tmp_path / "documents.parquet")
    query = catalog.queries()["c1_cleanup_candidates"]
    before = {r.file_id for r in query(spark, str(tmp_path)).collect()}
    first = knowledge.of(spark, str(tmp_path))
    assert knowledge.of(spark, str(tmp_path)) is first
    spark.read.parquet(f"{SF}/documents.parquet").filter(F.col("doc_id") % 2 == 0).write.parquet(str(tmp_path / "new"))
    (tmp_path / "documents.parquet").unlink()
    (tmp_path / "new").rename(tmp_path / "documents.parquet")
    spark.catalog.clearCache()
    after = {r.file_id for r in query(spark, str(tmp_path)).collect()}
    assert before and all(i % 2 == 0 for i in after) and after < before
    assert not shared.exists(first.rule_facts)  # what was made from the old table is gone
    knowledge.drop(spark, str(tmp_path))


def test_written_tables_outlive_nothing_that_is_dropped(spark):
    kept = shared.written(spark.range(3), "x")
    shared.drop(kept)
    assert not shared.exists(kept)
