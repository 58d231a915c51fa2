"""Connected components by alternating star contractions, as joins and aggregations of the edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentscope.llm.words import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction: every node ties its larger (or its smaller) neighbours and itself to the smallest of them."""
    both = edges.select(F.col("hi").alias("node"), F.col("lo").alias("other"))
    if large:
        both = both.unionByName(edges.select(F.col("lo").alias("node"), F.col("hi").alias("other")))
    least = both.groupBy("node").agg(F.min("other").alias("least")).withColumn("least", F.least("least", "node"))
    tied = both.join(least, "node")
    if large:
        out = tied.filter("other > node").select(F.col("other").alias("hi"), F.col("least").alias("lo"))
    else:
        out = tied.select(F.explode(F.array("other", "node")).alias("hi"), F.col("least").alias("lo"))
    return out.filter("hi <> lo").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that has an edge to another one; component is the smallest node reachable.

    Null ends and loops are left out; repeated edges count once; no edges give no rows. A node with very many edges is
    aggregated before the shuffle, and the join that hands out its smallest neighbour can be split.
    """
    edges = written(
        edges.filter(f"{a} <> {b}").select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct(), "edges"
    )
    mark = None
    while True:
        edges = written(_star(_star(edges, large=True), large=False), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)"))).first()
        if now == mark or not now[0]:
            break
        mark = now
    stars = edges.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
