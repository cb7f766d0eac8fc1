"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlake.llm.common import stored

#: Links of a partition: few links are not dealt to more tasks than they fill.
LINKS_PER_TASK = 50_000


def components(links: DataFrame) -> DataFrame:
    """(id, comp) for every end of ``links`` (a, b): comp is the smallest id reachable.

    Every round gives each node the smallest of itself and its neighbours, then that node's
    smallest, and contracts: links between the new nodes go on, once each.  A node that is not
    the smallest around it is gone after the round, so the links shrink with every round, and
    labels are written between rounds, which cuts the lineage.  Minima are combined in the map
    tasks, so a node of very many links is no hot key.
    """
    edges, labels = links.select("a", "b"), None
    while (number := edges.count()) or labels is None:
        tasks = 1 + number // LINKS_PER_TASK
        both = edges.union(edges.select("b", "a")).coalesce(tasks)
        near = stored(both.groupBy("a").agg(
            F.least("a", F.min("b")).alias("comp")).withColumnRenamed("a", "id"), "labels-near")
        jump = near.select(F.col("id").alias("root"), F.col("comp").alias("next"))
        step = stored(near.join(jump, F.col("comp") == F.col("root")).select(
            "id", F.col("next").alias("comp")), "labels-step")
        if labels is None:
            labels = step
        else:
            after = step.select(F.col("id").alias("root"), F.col("comp").alias("next"))
            labels = stored(labels.join(after, F.col("comp") == F.col("root"), "left").select(
                "id", F.coalesce("next", "comp").alias("comp")), "labels")
        left = step.select(F.col("id").alias("a"), F.col("comp").alias("x"))
        right = step.select(F.col("id").alias("b"), F.col("comp").alias("y"))
        edges = stored(edges.coalesce(tasks).join(left, "a").join(right, "b").where("x <> y").select(
            F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    return labels
