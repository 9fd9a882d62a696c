"""Connected components of an edge table by alternating large and small stars.

Each round joins a node's neighbours with the least of them, which partial minima give, so a hub's edges may
be split among tasks; they shrink to one per neighbour, and the number of rounds grows with the logarithm of
the components' size.  Only counts reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import stored


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")


def _star(directed: DataFrame, large: bool) -> DataFrame:
    """Links each node's neighbours to the smallest of them and itself: those above the node, or those below and the node."""
    least = directed.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))  # a hub is summed up before the shuffle
    seen = directed.join(least, "u")
    if large:
        out = seen.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        own = F.explode(F.array(F.col("v"), F.col("u")))
        out = seen.select(own.alias("u"), F.col("m").alias("v"))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every node of ``edges(u, v)``; component is the smallest id reachable.

    Loops, repeated edges and edges with a null end add nothing; an empty table gives an empty result.
    """
    now = stored(edges.select("u", "v").filter("u is not null and v is not null and u <> v").distinct(), "edges")
    before = None
    while True:
        large = _star(_both(now), large=True)
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        now = stored(_star(down, large=False), "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return now.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component")).unionByName(
        now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    ).groupBy("id").agg(F.min("component").alias("component"))
