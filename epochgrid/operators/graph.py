"""Connected components of a graph given as edges, by alternating large and small stars.

Each round replaces the edges by edges to the smallest neighbour; the number of rounds grows with the logarithm of a
component's diameter. Nodes' neighbours are never collected: minima are aggregated before the shuffle and joined back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochgrid.session import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """(u, v), u > v, of the next step."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        moved = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.withColumnRenamed("m", "v"))
    return moved.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of each node that has an edge; a component is named by its smallest node.

    Loops, repeated edges and edges with a null end change nothing. An empty input has no components.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull()).filter("u <> v").distinct()
    now = written(now)
    mark = None
    while True:
        now = written(_star(_star(now, True), False))
        # a sum of hashes as decimals can't overflow, whatever the number of edges
        new = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if new == mark or new[0] == 0:
            break
        mark = new
    heads = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(heads)
