"""Connected components of a link table, by label propagation with pointer jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._stage import stage


def components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` -> ``(id, component)``: the smallest id reachable, for every id in a link.

    Null ends and self links add nothing. Each round takes the smallest label among
    the neighbours and then the label of that label, so long chains shrink by halves.
    Nothing is collected but one flag a round; each round is a table in the shared folder.
    """
    links = links.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct()
    edges = stage(links.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b").distinct(), "edges")
    labels = stage(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        near = edges.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        step = labels.join(near, "id").select("id", F.least("component", "near").alias("component"), F.col("component").alias("before"))
        jump = labels.select(F.col("id").alias("component"), F.col("component").alias("further"))
        step = stage(step.join(jump, "component").select("id", F.least("component", "further").alias("component"), (F.least("component", "further") != F.col("before")).alias("moved")), "labels")
        labels = step.select("id", "component")
        if step.where("moved").isEmpty():
            return labels
