"""Connected components over a distributed list of links, in rounds of joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _toward_smallest(links: DataFrame, label: str) -> DataFrame:
    """Links (a, b) with the smallest neighbour of each a. That table is written first, so that both sides of the join
    come straight from a shuffle and Spark can split a node that has very many links."""
    smallest = stored(links.groupBy("a").agg(F.min("b").alias("m")), label)
    return links.join(smallest, "a")


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """Root (smallest member) of every node that has a link: links (a long, b long) -> (node long, root long).

    Large and small stars in turn: every node hands its larger neighbours, then its smaller ones, to its smallest
    neighbour. The number of rounds grows with the logarithm of the longest path. Nothing but a count and a sum of
    hashes a round reaches the driver. Null links and links to oneself are ignored. Fails rather than returning an
    unfinished result.
    """
    current = stored(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = None
    for _ in range(rounds):
        state = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                current.select("b", "b").distinct())
        seen = state
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _toward_smallest(both, "large").where("b > a").select(
            F.col("b").alias("a"), F.least("a", "m").alias("b"))
        large = stored(large, "stars")
        small = _toward_smallest(large, "small")
        current = stored(
            small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(small.select("a", "m")).distinct(), "links")
    raise RuntimeError(f"components did not settle in {rounds} rounds")
