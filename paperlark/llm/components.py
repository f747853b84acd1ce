"""Connected components of a graph of links, by alternating large and small stars.

Each step keeps, for every node, links to the smallest neighbour only, until every component is a star around its smallest
node; the number of steps grows with the logarithm of the component. Nothing is collected: a step is one aggregation
with partial minima and one join with them. A hub's rows need not meet in one task: the minima of nodes of more than
1 / HUBS of all links, HUBS of them at most, are broadcast, and its rows are dealt out by their other end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlark.llm.common import cut

#: A bound of the hubs whose minima, 16 bytes each, are broadcast.
HUBS = 50_000


def _beside_least(rows: DataFrame, links: DataFrame, n: int) -> DataFrame:
    """rows(a, b) with m, the least b that links, n of them at most, has for a."""
    least = links.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("k"))
    most = max(64, n // HUBS)
    hubs = least.where(F.col("k") > most).select("a", F.col("m").alias("hub_m"))
    # part is 0 for them all, in a form that the optimizer does not know: else it joins by a alone
    others = least.where(F.col("k") <= most).select("a", "m", F.when(F.col("k") > most, 1).otherwise(0).alias("part"))
    dealt = rows.join(F.broadcast(hubs), "a", "left").withColumn("part", F.when(F.col("hub_m").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64("b"), F.lit(HUBS)).cast("int")))
    return dealt.join(others, ["a", "part"], "left").select("a", "b", F.coalesce("m", "hub_m").alias("m"))


def _large_star(links: DataFrame, n: int) -> DataFrame:
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    rows = _beside_least(both.where("b > a"), both, 2 * n)
    return rows.select(F.col("b").alias("a"), F.least("a", "m").alias("b")).where("a <> b").distinct()


def _small_star(links: DataFrame, n: int) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    rows = _beside_least(down, down, n)
    return rows.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()


def stars(links: DataFrame) -> DataFrame:
    """links(a, b), a and b being different long numbers -> (a, b): each node but a component's smallest, with that one.

    Repeated links count once, a link of a node with itself for nothing; without links there are no rows.
    """
    links = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    mark = lambda df: df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    before = mark(links)
    while before.n:
        large = cut(_large_star(links, before.n))
        links = cut(_small_star(large, large.count()))
        if (now := mark(links)) == before:
            break
        before = now
    return links
