"""Connected components of a link table by alternating large and small stars.

Each round is two joins and two aggregations over the links alone, all of them
partially aggregated before they shuffle, and ends in a table in the shared
folder.  Nothing about single links or components reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash


def _state(links: DataFrame) -> tuple:
    return tuple(
        links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    )


def _nearest(neighbours: DataFrame) -> DataFrame:
    return neighbours.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))


def connected_components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links(a, b)``, root its smallest peer.

    Null ends and links of a node with itself are left out.  An empty table
    gives an empty one.
    """
    links = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = stash(links, "links")
    before = _state(links)
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(_nearest(both), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = _nearest(large)
        small = (
            large.join(low, "a")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(low.select("a", F.col("m").alias("b")))
            .where("a <> b")
            .distinct()
        )
        links = stash(small, "links")
        now = _state(links)
        if now == before:
            break
        before = now
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
