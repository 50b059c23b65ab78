"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.textkit import drop, settle


def _is_stars(links: DataFrame) -> bool:
    """Whether every larger id has one link, to an id that is the larger one of none."""
    held = links.groupBy("a").agg(F.count("*").alias("n"))
    if not held.where("n > 1").isEmpty():
        return False
    return links.join(links.select(F.col("a").alias("b")), "b", "left_semi").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(id, component) for each id in links (a, b): the smallest id reachable.

    Alternates two steps until only stars are left: every node hands its larger
    neighbours to its smallest neighbour, then its smaller ones.  The table never grows
    beyond its links, and rounds grow with the logarithm of a component's size.  The
    smallest neighbours are combined before their shuffle and written out before they
    meet the links, so that both sides of that join are plain tables: where one is small
    it is broadcast by Spark, else the adaptive skew join splits a node with many links.
    """
    links = settle(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    while not _is_stars(links):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = settle(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = settle(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "large")
        below = settle(large.groupBy("a").agg(F.min("b").alias("m")), "below")
        small = large.join(below, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b")))
        done = [links, least, large, below]
        links = settle(small.where("a <> b").distinct(), "links")
        for table in done:
            drop(table)
    stars = links.withColumnsRenamed({"a": "id", "b": "component"})
    roots = stars.select(F.col("component").alias("id")).distinct()
    return stars.select("id", "component").unionByName(roots.select("id", F.col("id").alias("component")))
