"""Connected components of a link table, by alternating large-star and small-star steps."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.work import cut


def _checksum(edges: DataFrame) -> tuple:
    """Number of links and a sum of their hashes (modulo 2**31 each, so the sum stays exact)."""
    return tuple(edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first())


def _least(edges: DataFrame) -> DataFrame:
    """Each node's smallest neighbour or itself: a partial aggregate, so a hub meets as one row a task.

    Written as a table of its own, so that a hub's links can be split over tasks in the join with it.
    """
    return cut(edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the smallest node reachable) for every node that occurs in ``links``.

    Each round ties nodes to smaller ones until the links are stars; rounds grow with the logarithm of the longest
    path. Every round is written to the shared folder. Nothing but a count and a checksum reaches the driver. Links in
    either direction, repeated links and loops are allowed, null ends are ignored; an empty table gives no rows.
    """
    edges = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges = cut(edges, "links")
    before = _checksum(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.join(_least(large), "u").select("u", "v", "m")
        small = small.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).distinct()
        edges = cut(small, "stars")
        after = _checksum(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
