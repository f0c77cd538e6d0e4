"""Connected components of an edge table, by joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm import store


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id of ``edges`` (src, dst), the component being its smallest id.

    Each round gives an id the least label among its own and its neighbours'
    (sums are partial before the shuffle), then its label's label, which halves
    paths, until no label changes. Labels are written to the shared folder each
    round; the driver sees one count.
    """
    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    both = store.written(both.filter("src <> dst").distinct(), "edges")
    labels = store.written(both.groupBy(F.col("src").alias("id")).agg(F.least("id", F.min("dst")).alias("component")), "labels")
    while True:
        heard = both.join(labels, both["src"] == labels["id"]).groupBy(F.col("dst").alias("id")).agg(F.min("component").alias("heard"))
        near = labels.join(heard, "id").select("id", F.least("component", "heard").alias("near"), F.col("component").alias("before"))
        jump = labels.select(F.col("id").alias("near"), F.col("component").alias("far"))
        new = near.join(jump, "near").select("id", F.least("near", "far").alias("component"), "before")
        new = store.written(new, "labels")
        done = not new.filter("component <> before").limit(1).count()
        store.drop(labels)
        labels = new.select("id", "component")
        labels.shelfmark_path = new.shelfmark_path
        if done:
            store.drop(both)
            return labels
