"""Connected components of an undirected edge table, by alternating star contractions.

Each round first lets every node hand its larger neighbours to its smallest one, then lets every
node hand all its smaller neighbours to the smallest.  Both keep components unchanged and only
lower the far end of an edge, so the table ends as stars round the smallest node of each component.
Minima are taken with map-side combined aggregates and brought back by joins that the adaptive
planner can split, so a hub's edges are never gathered in one task.  Every round ends in a table in
the shared folder, and the table before it is removed.  Nothing but one row of counts reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.cut import discard, written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    inner = edges.join(least.withColumnRenamed("u", "c"), F.col("u") == F.col("c")).filter("v <> m")
    return inner.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))


def _is_stars(edges: DataFrame) -> bool:
    """Every child has one parent and no parent is a child."""
    roles = edges.select(F.col("u").alias("x"), F.lit(1).alias("child"), F.lit(0).alias("parent")).union(
        edges.select(F.col("v").alias("x"), F.lit(0).alias("child"), F.lit(1).alias("parent")))
    node = roles.groupBy("x").agg(F.sum("child").alias("n"), F.max("parent").alias("p"))
    return node.agg(F.max(((F.col("n") > 1) | ((F.col("n") > 0) & (F.col("p") > 0))).cast("int"))).first()[0] in (None, 0)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that has an edge to another node; the component is its smallest node.

    ``edges`` has columns a, b of one orderable type, in any direction and any number of times;
    loops and edges with a null end are ignored.  The loop ends by convergence alone.
    """
    stars = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while not _is_stars(stars):
        before, stars = stars, written(_small_star(_large_star(stars).distinct()).distinct())
        discard(before)
    roots = stars.select("v").distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        roots.select(F.col("v").alias("node"), F.col("v").alias("component")))
