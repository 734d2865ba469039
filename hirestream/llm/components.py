"""Connected components of a link table, distributed."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``links`` (``a, b``): the smallest node reachable.

    Each pass takes the least label of a node's neighbours (combined before the shuffle,
    so a hub is no hot spot) and then the label of that label; passes end when no label
    changes. Labels are checkpointed, so lineage does not grow."""
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
                        .filter("a <> b").distinct())
    labels = written(both.groupBy("a").agg(F.min("b").alias("near"))
                         .select(F.col("a").alias("node"), F.least("a", "near").alias("label")))
    while True:
        heard = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("heard"))
        told = (labels.join(heard, labels["node"] == heard["a"])
                      .select("node", F.col("label").alias("old"), F.least("label", "heard").alias("label")))
        of = labels.select(F.col("node").alias("of"), F.col("label").alias("far"))
        new = written(told.join(of, told["label"] == of["of"]).select("node", F.least("label", "far").alias("label"), "old"),
                      instead_of=labels)
        labels = new
        if new.filter("label <> old").isEmpty():
            return new.select("node", "label")
