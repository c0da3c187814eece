"""Running sums, ranks and neighbours in an order, without a task that holds a whole group.

Rows are dealt out by ranges of (group, order), so that a task has a stretch of one or more groups. Each stretch is
added up by itself; what comes before it in its group is a sum over one row a group and stretch. Rows that agree in the
whole order share a stretch, so give a column that tells them apart where many do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ketframe.operators.rounds import cut

STRETCH = "__stretch"


def stretches(df: DataFrame, within: list[str], order: list[str]) -> DataFrame:
    """df dealt out by ranges, with the number of each row's stretch."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(n, *within, *order).withColumn(STRETCH, F.spark_partition_id()))


def running_sums(df: DataFrame, within: list[str], order: list[str], sums: dict[str, Column], rows: DataFrame | None = None) -> DataFrame:
    """df with running sums, each row included, of `sums` in each group. rows: what `stretches` has made of df already."""
    rows = stretches(df, within, order) if rows is None else rows
    rows = rows.withColumns({f"__of_{name}": c for name, c in sums.items()})
    each = rows.groupBy(*within, STRETCH).agg(*(F.sum(f"__of_{name}").alias(f"__of_{name}") for name in sums))  # a row a group and stretch
    earlier = W.partitionBy(*within).orderBy(STRETCH).rowsBetween(W.unboundedPreceding, -1)
    before = each.select(*within, STRETCH, *(F.coalesce(F.sum(f"__of_{name}").over(earlier), F.lit(0)).alias(f"__to_{name}") for name in sums))
    here = W.partitionBy(*within, STRETCH).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    local = rows.withColumns({f"__in_{name}": F.sum(f"__of_{name}").over(here) for name in sums})
    keys = [F.col(f"l.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*within, STRETCH]]
    both = local.alias("l").join(before.alias("b"), keys)
    return both.select(*(F.col(f"l.{c}") for c in df.columns if c != STRETCH), *((F.col(f"__in_{name}") + F.col(f"__to_{name}")).alias(name) for name in sums))


def ranks(df: DataFrame, within: list[str], order: list[str], out_col: str = "rank") -> DataFrame:
    """df with each row's place in its group, from 1; `order` tells rows apart."""
    return running_sums(df, within, order, {out_col: F.lit(1).cast("long")})


def following(df: DataFrame, within: list[str], order: list[str], of: str, out_col: str) -> DataFrame:
    """df with the value of `of` in the next row of the group, null in the last."""
    rows = stretches(df, within, order)
    first = rows.groupBy(*within, STRETCH).agg(F.min_by(of, F.struct(*order)).alias("__first"))  # a row a group and stretch
    after = first.withColumn("__next", F.lead("__first").over(W.partitionBy(*within).orderBy(STRETCH))).drop("__first")
    local = rows.withColumn("__lead", F.lead(of).over(W.partitionBy(*within, STRETCH).orderBy(*order)))
    keys = [F.col(f"l.{c}").eqNullSafe(F.col(f"a.{c}")) for c in [*within, STRETCH]]
    return local.alias("l").join(after.alias("a"), keys).select(*(F.col(f"l.{c}") for c in df.columns), F.coalesce("__lead", "__next").alias(out_col))


def latest(df: DataFrame, within: list[str], order: list[str], of: list[str]) -> DataFrame:
    """df with nulls in the columns `of` filled from the last earlier row of the group that has a value."""
    rows = stretches(df, within, order)
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct(*order, c)))[c]
    each = rows.groupBy(*within, STRETCH).agg(*(last(c).alias(c) for c in of))  # a row a group and stretch
    earlier = W.partitionBy(*within).orderBy(STRETCH).rowsBetween(W.unboundedPreceding, -1)
    before = each.select(*within, STRETCH, *(F.last(c, ignorenulls=True).over(earlier).alias(f"__to_{c}") for c in of))
    here = W.partitionBy(*within, STRETCH).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    local = rows.withColumns({f"__in_{c}": F.last(c, ignorenulls=True).over(here) for c in of})
    keys = [F.col(f"l.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*within, STRETCH]]
    both = local.alias("l").join(before.alias("b"), keys)
    return both.select(*(F.coalesce(f"__in_{c}", f"__to_{c}").alias(c) if c in of else F.col(f"l.{c}") for c in df.columns))


def average_ranks(df: DataFrame, within: list[str], of: str, out_col: str) -> DataFrame:
    """df with the rank of a value in its group, the mean of the places where several rows have it; null for null."""
    counts = df.where(F.col(of).isNotNull()).groupBy(*within, of).agg(F.count("*").alias("__n"))
    placed = running_sums(counts, within, [of], {"__upto": F.col("__n")})
    found = placed.select(*within, of, (F.col("__upto") - (F.col("__n") - 1) / 2).alias(out_col))
    keys = [F.col(f"d.{c}").eqNullSafe(F.col(f"f.{c}")) for c in [*within, of]]
    return df.alias("d").join(found.alias("f"), keys, "left").select("d.*", f"f.{out_col}")
