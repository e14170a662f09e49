"""Connected components of a link table, distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, saved


def components(links: DataFrame, a: str = "u", b: str = "v") -> DataFrame:
    """(node, component): the smallest node reachable, for the nodes that have links.

    Alternates large-star and small-star contraction until nothing changes: a number of
    rounds that grows with the logarithm of a component's diameter.  A half round is one
    aggregate (combined before its shuffle) and one join that Spark may split when a
    hub is hot.  Rounds are written to the shared folder; links never reach the driver.
    Links with a null end, and loops, are left out.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} is not null and {b} is not null and {a} <> {b}").distinct()
    edges, mark = saved(edges), None
    n = 2 * edges.count()  # rows that a round can have
    while True:
        both = edges.union(edges.select("v", "u"))
        # written, so that Spark can split a hub's links in the join
        least = saved(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), rows=n)
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = saved(large, rows=n)
        nearest = saved(large.groupBy("u").agg(F.min("v").alias("m")), rows=n)
        small = large.join(nearest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(nearest.select("u", F.col("m").alias("v")))
        new = saved(small.distinct(), rows=n)
        found = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        for done in (edges, least, large, nearest):
            dropped(done)
        edges = new
        if found == mark:
            break
        mark = found
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v"), F.col("v")).distinct())
