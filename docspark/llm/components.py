"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import discard, written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(``node``, ``component``) for every node of ``links``; the component is its smallest node.  A written table.

    Each round points every node at its smallest neighbour, follows the pointers three steps, renames the links'
    ends and drops those inside one group.  Minima are pre-aggregated before the shuffle, and every join is of
    written tables, so that a node with very many links does not bind a task.  A path of n nodes shrinks at
    least fourfold a round.
    """
    edges = written(
        links.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u <> v").distinct(), "links"
    )
    nodes = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    names = written(nodes.select("node", F.col("node").alias("component")), "components")
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        up = both.groupBy("u").agg(F.min("v").alias("p")).select(F.col("u").alias("c"), F.least("u", "p").alias("p"))
        up = written(up, "pointers")
        for _ in range(2):
            over = up.select(F.col("c").alias("p"), F.col("p").alias("q"))
            before, up = up, written(up.join(over, "p").select("c", F.col("q").alias("p")), "pointers")
            discard(before)
        read = edges
        for end in ("u", "v"):
            edges = edges.join(up.withColumnRenamed("c", end), end).withColumn(end, F.col("p")).drop("p")
        edges = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct()
        before, edges = read, written(edges, "links")
        renamed = names.join(up.withColumnRenamed("c", "component"), "component", "left")
        older, names = names, written(renamed.select("node", F.coalesce("p", "component").alias("component")), "components")
        discard(before, up, older)
    discard(edges)
    return names
