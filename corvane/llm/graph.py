"""Connected components of an edge table, without leaving Spark.

Edge cases: an empty table has no nodes; null ends are left out; repeated edges and loops
change nothing; a component may have any size; nodes are numbers, so ties don't arise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored

MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the component's smallest node.

    Alternating large-star and small-star steps; each round is a table in the
    shared folder, so no lineage grows and a lost executor costs one round at
    most. Node sums decide on the end, so nothing but three numbers reaches the
    driver. Null ends are ignored; loops keep their node.
    """
    spark = edges.sparkSession
    current = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a is not null and b is not null").distinct(), "cc")
    nodes = current.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    first = nodes_table = stored(nodes, "cc-nodes")
    current, was = _proper(current), None
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    for _ in range(MAX_ROUNDS):
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large star: larger neighbours of a node are tied to the smallest of the node and its neighbours
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a node and its smaller neighbours are tied to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        following = stored(_proper(small.distinct()), "cc")
        now = mark(following)
        discard(spark, current)
        current = following
        if now == was:
            break
        was = now
    else:
        raise RuntimeError(f"no fixed point in {MAX_ROUNDS} rounds")
    return first.join(current.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def _proper(edges: DataFrame) -> DataFrame:
    return edges.filter("a <> b")
