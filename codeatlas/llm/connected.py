"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from codeatlas.session import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b) of whole numbers: root is the least node that can be reached.

    Each round lets a node point at its least neighbour if that is less than itself, follows the pointers to their ends by doubling
    (three times per written table), and goes on with the edges between the ends, so the number of nodes at least halves.  Every step is a written
    table.  Neighbours are reduced before they are shuffled; nothing gathers the neighbours of a node.
    """
    rest = cut(edges.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    rounds = []
    while not rest.isEmpty():
        both = rest.unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        points = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to")).select("node", F.least("node", "to").alias("root")))
        while True:
            far = points.withColumn("moved", F.lit(False))
            for _ in range(3):
                ends = far.select(F.col("node").alias("root"), F.col("root").alias("next"))
                far = far.join(ends, "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved"))
            far = cut(far)
            points = far.select("node", "root")
            if far.filter("moved").isEmpty():
                break
        rounds.append(points)
        for end in ("a", "b"):
            rest = rest.join(points.select(F.col("node").alias(end), F.col("root").alias("_root")), end).drop(end).withColumnRenamed("_root", end)
        rest = cut(rest.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if not rounds:
        return rest.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = rounds[0]
    for later in rounds[1:]:
        found = found.join(later.select(F.col("node").alias("root"), F.col("root").alias("_root")), "root", "left").select("node", F.coalesce("_root", "root").alias("root"))
    return cut(found)
