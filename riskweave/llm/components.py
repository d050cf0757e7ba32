"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.session import reliable_checkpoint

MOST_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """node, root for every node of the links (a, b): the smallest node reachable.

    Alternating large and small stars: every round ties each node's larger (then smaller) neighbours to its smallest
    neighbour by a partial aggregate and a join, so a node with very many links is never gathered in one place. The
    number of rounds grows with the logarithm of the longest chain. Each round is cut off by a written table.
    """
    edges = reliable_checkpoint(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    )
    for _ in range(MOST_ROUNDS):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        tied = large.join(low, "a")
        small = tied.select("a", F.col("m").alias("b")).unionByName(tied.select(F.col("b").alias("a"), F.col("m").alias("b")))
        small = small.filter("a <> b").distinct()
        new = reliable_checkpoint(small)
        # Done when every node has one link, to a node that has no smaller neighbour itself.
        stars = new.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
        crowded = stars.filter("n > 1").limit(1).count()
        chained = new.join(new.select(F.col("a").alias("b")).distinct(), "b", "left_semi").limit(1).count()
        edges = new
        if not crowded and not chained:
            break
    else:
        raise RuntimeError(f"components didn't settle in {MOST_ROUNDS} rounds")
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
