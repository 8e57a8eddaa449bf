"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracehold.llm.storage import discard, written


def components(links: DataFrame) -> DataFrame:
    """(node, component): the least node reachable from each node of links (a, b); both are longs.

    Alternating large-star and small-star steps. A hub's neighbours are never gathered: each step takes minima by
    partial aggregation and joins them back to the links. Steps are written to the shared folder. Links of a node to
    itself and repeated links change nothing; without links the result is empty.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    seen = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, edges = edges, written(small.union(lowest.select("u", F.col("m").alias("v"))).distinct(), "links")
        discard(before)
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("long"))).first()
        if now == seen:
            break
        seen = now
    parents = edges.groupBy("u").agg(F.min("v").alias("v"))
    return parents.select(F.col("u").alias("node"), F.col("v").alias("component")).union(parents.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
