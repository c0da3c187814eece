"""Connected components of a link table by alternating large and small stars.

Every round replaces the links by equivalent ones that hang closer to each
component's smallest node; rounds grow with the logarithm of the size. A node's
minimum is a grouped aggregate that combines before it is shuffled, and the
join that hands it to the node's links is a plain equi-join, so that a hub with
very many links is split by the skew handling of adaptive execution.
Each round is written to the shared folder, which keeps lineage short and
survives lost executors. Only a row count and a checksum reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ketframe.llm._common import materialize, release


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links: (a, b), a > b, distinct. One star step, again as distinct links with a > b."""
    if large:
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        moved = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        least = links.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        joined = links.select(F.col("a").alias("u"), F.col("b").alias("v")).join(least, "u")
        moved = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.where("a > b").distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of every node that has a link to another; root is the smallest node reachable.

    Nulls and links of a node to itself say nothing and are left out; repeated links count once.
    """
    x, y = F.col(a), F.col(b)
    now = materialize(links.where(x != y).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct(), "links")
    mark = None
    while True:
        sums = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (sums.n, sums.h) == mark or not sums.n:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        mark = (sums.n, sums.h)
        after = materialize(_star(_star(now, large=True), large=False), "links")
        release(now)
        now = after
