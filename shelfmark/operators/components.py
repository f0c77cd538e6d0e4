"""Connected components of an edge table, by joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.sources import shared


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id of ``edges`` (src, dst): the smallest id that edges lead to.

    A round takes the least label among an id's own and its neighbours', then that label's
    own label, so long chains shorten by halves. Labels are written to the shared folder each round.
    """
    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).filter("src <> dst").distinct()
    both = shared.written(both, "edges")
    labels = shared.written(both.groupBy(F.col("src").alias("id")).agg(F.least("id", F.min("dst")).alias("component")), "labels")
    while True:
        heard = both.join(labels.select(F.col("id").alias("src"), "component"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("component").alias("heard"))
        near = labels.join(heard, "id").select("id", F.least("component", "heard").alias("near"), F.col("component").alias("was"))
        far = labels.select(F.col("id").alias("near"), F.col("component").alias("far"))
        new = shared.written(near.join(far, "near").select("id", F.least("near", "far").alias("component"), "was"), "labels")
        if not new.filter("component <> was").limit(1).count():
            return new.select("id", "component")
        labels = new.select("id", "component")
