"""Connected components of a table of links, in rounds of joins and partial minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statuta.session import cut_lineage


def _large_star(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours are tied to the smallest node around it."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are tied to the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    tied = down.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node with a link; root is the smallest node of its component.

    `links` has two columns a, b of one ordered type, without nulls; loops and repeated links do no harm.
    Alternates the two star steps until nothing changes; every round is written to the shared folder, so
    plans stay short and lost executors cost one round. Minima are combined before they are shuffled.
    """
    links = cut_lineage(links.select("a", "b").where("a != b").distinct(), "links")
    before = None
    while True:
        links = cut_lineage(_small_star(_large_star(links)), "links")
        now = tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return roots.union(links.select("b", "b").distinct())
        before = now
