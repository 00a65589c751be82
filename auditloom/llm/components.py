"""Connected components of links between integer ids, in distributed rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in ``links`` (a, b): the smallest id that can be reached.

    Each round takes the smallest label among the neighbours and then the label of that label, so long
    chains shrink by half or better. Labels are tables in the shared folder; a hot id is met by partial
    minima and skew joins, never by one group.
    """
    both = materialize(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "links")
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("component").alias("near"))
        step = labels.join(near, labels["id"] == near["a"]).select("id", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        root = labels.select(F.col("id").alias("root"), F.col("component").alias("above"))
        jumped = materialize(step.join(root, step["component"] == root["root"], "left").select(
            "id", "old", F.least("component", F.coalesce("above", "component")).alias("component")), "labels")
        if jumped.where("old <> component").isEmpty():
            return jumped.select("id", "component")
        labels = jumped.select("id", "component")
