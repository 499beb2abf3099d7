"""Connected components by alternating large and small stars over an edge table.

Each round is two aggregations (combined before the shuffle) and two joins on plain shuffles, so a
node with very many edges can be split; rounds are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawlkit.session import written_table



def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component) for every node of an edge; component is the least node reachable.

    Loops and repeated edges do no harm; an edge with a null end ties nothing. An empty table gives
    no rows.
    """
    now = written_table(
        edges.select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b"))
        .where(F.col(left).isNotNull() & F.col(right).isNotNull())
        .where(F.col("a") != F.col("b"))
        .distinct(),
        "edges",
    )
    before = _digest(now)
    while before[0]:
        # Large star: greater neighbours of a node go to the least of its neighbourhood.
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written_table(large.where(F.col("a") != F.col("b")).distinct(), "large-star")
        # Small star: lesser neighbours of a node, and the node, go to the least of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        now = written_table(small, "small-star")
        after = _digest(now)
        if after == before:
            break
        before = after
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
