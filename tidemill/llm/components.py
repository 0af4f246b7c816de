"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.plans.stored import stored


def connected_components(edges: DataFrame) -> DataFrame:
    """``(id, component)`` for every id of ``edges(a, b)``: the smallest id that it reaches.

    Each round points every node at the least of itself and its neighbours (pre-aggregated before the shuffle, so a
    node with very many neighbours is no burden), follows the pointers once more, and contracts: edges then tie what
    the nodes point at, and those within a contracted node go. Rounds end when no edge is left; each is a written
    table. An empty edge table gives an empty result; repeated edges and self loops change nothing.
    """
    ends = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    labels = ends.select(F.col("a").alias("id")).union(ends.select("b")).distinct().withColumn("component", F.col("id"))
    ends = ends.filter("a <> b")
    while not ends.isEmpty():
        points = ends.select(F.col("a").alias("id"), F.col("a").alias("to")).union(ends.select("b", "a")).groupBy("id").agg(F.min("to").alias("to"))
        points = stored(points, "points")
        jump = points.select(F.col("id").alias("to"), F.col("to").alias("next"))
        points = stored(points.join(jump, "to").select("id", F.col("next").alias("to")), "points")
        labels = labels.join(points.select(F.col("id").alias("component"), "to"), "component", "left")
        labels = stored(labels.select("id", F.coalesce("to", "component").alias("component")), "labels")
        left, right = points.select(F.col("id").alias("a"), F.col("to").alias("la")), points.select(F.col("id").alias("b"), F.col("to").alias("lb"))
        ends = ends.join(left, "a").join(right, "b").filter("la <> lb")
        ends = stored(ends.select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct(), "links")
    return labels
