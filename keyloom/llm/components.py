"""Connected components of links, by alternating large-star and small-star steps.

Each step sends neighbours to the least of a neighbourhood; minima are formed before the shuffle, and the join that
follows may be split by adaptive execution at a node with very many links.  Steps are written to the shared folder;
they go on until every component is a star, which takes a number of steps that grows with the logarithm of its size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import drop_table, materialize

def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of links (a, b): component is the least node of its component."""
    links = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    links = materialize(links, "links", few=True)
    while True:
        both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # every node now has only smaller neighbours
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionAll(least.select("u", F.col("m").alias("v"))).distinct()
        after = materialize(small, "small-star", few=True)
        drop_table(links)
        links = after
        if _settled(links):
            break
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)


def _settled(links: DataFrame) -> bool:
    """Whether every node has one smaller neighbour at most and none that has one is another's: each component is a star."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("below")).unionAll(links.select(F.col("v").alias("node"), F.lit(0).alias("below")))
    nodes = ends.groupBy("node").agg(F.sum("below").alias("below"), F.min("below").alias("least"))
    return nodes.where("below > 1 or (below = 1 and least = 0)").isEmpty()
