"""The largest value that another row's line has at a row's place.

A row has a line (slope, height) and a place. Only two layers of lines can be largest, or second to a row's own line,
anywhere: the upper envelope, and that of the lines left. A layer of a union lies within the layers of its parts, so each
task keeps two layers of the rows it has seen, parts are merged by salted groups, and then by group. The pieces of both
layers are sorted among the rows by place; a row reads those that last began before it. No pair of rows is formed and no
task holds a group's rows.

What one task holds of a group are its two layers. Random lines leave some tens of millions; lines that are all
tangents of one parabola all stay, at 24 bytes each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ketframe.functions.columns import finite
from ketframe.operators.ranks import latest
from ketframe.operators.rounds import cut

MERGES = 64
LINE = "struct<slope: double, height: double>"


def upper(slope: np.ndarray, height: np.ndarray) -> np.ndarray:
    """Which lines are largest somewhere, by ascending slope; of equal lines one, and none that only touches."""
    chain: list[int] = []
    m, c = slope.tolist(), height.tolist()
    for i in np.lexsort((height, slope)).tolist():
        if chain and m[chain[-1]] == m[i]:
            chain.pop()
        while len(chain) > 1:
            a, b = chain[-2], chain[-1]
            if (c[i] - c[a]) * (m[b] - m[a]) < (c[b] - c[a]) * (m[i] - m[a]):
                break
            chain.pop()
        chain.append(i)
    return np.array(chain, dtype=np.int64)


def two_layers(lines: pd.DataFrame) -> list[pd.DataFrame]:
    """The envelope of lines (slope, height, copies) and that of the others."""
    lines = lines.groupby(["slope", "height"], as_index=False)["copies"].sum()
    first = upper(lines["slope"].to_numpy(), lines["height"].to_numpy())
    rest = lines.drop(index=first)
    return [lines.iloc[first], rest.iloc[upper(rest["slope"].to_numpy(), rest["height"].to_numpy())]]


def _pieces(layer: pd.DataFrame) -> pd.DataFrame:
    """Each line of a layer with the place where it begins to be largest and the lines beside it."""
    m, c = layer["slope"].to_numpy(), layer["height"].to_numpy()
    lines = [{"slope": float(a), "height": float(b)} for a, b in zip(m, c)]
    start = np.concatenate([[-np.inf], -np.diff(c) / np.diff(m)]) if len(m) else np.array([])
    return pd.DataFrame({"start": start, "line": lines, "copies": layer["copies"].to_numpy(), "left": [None, *lines[:-1]][: len(lines)], "right": [*lines[1:], None][: len(lines)]})


def _layers(lines: DataFrame, within: list[str]) -> DataFrame:
    """(within, start, first, second): the pieces of both layers of each group."""
    fields = lines.select(*within).schema
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    shape = f"{keys}, slope double, height double, copies long"

    def thin(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None
        for f in frames:
            every = f if kept is None else pd.concat([kept, f])
            parts = [pd.concat(two_layers(part)).assign(**dict(zip(within, key))) for key, part in every.groupby(within, dropna=False)]
            kept = pd.concat(parts)[[*within, "slope", "height", "copies"]] if parts else None
        if kept is not None:
            yield kept

    def merge(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return pd.concat(two_layers(part)).assign(**dict(zip(within, key)))[[*within, "slope", "height", "copies"]]

    def finish(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        first, second = map(_pieces, two_layers(part))
        first["first"] = first[["line", "copies", "left", "right"]].to_dict("records")
        out = pd.concat([first[["start", "first"]], second[["start", "line"]].rename(columns={"line": "second"})])
        out = out.astype(object).where(out.notna(), None).astype({"start": "float64"})
        return out.assign(**dict(zip(within, key)))[[*within, "start", "first", "second"]]

    few = lines.mapInPandas(thin, shape).withColumn("__salt", F.spark_partition_id() % MERGES)
    few = few.groupBy(*within, "__salt").applyInPandas(merge, shape)
    return few.groupBy(*within).applyInPandas(finish, f"{keys}, start double, first struct<line: {LINE}, copies: long, left: {LINE}, right: {LINE}>, second {LINE}")


def largest_other(df: DataFrame, within: list[str], at: str, slope: str, height: str, out_col: str = "largest_other") -> DataFrame:
    """df with the largest slope * at + height of the group's other rows at the row's own place.

    Null for a row without another, and for one whose place or line is null or not finite, which is no line to others
    either. Equal lines of several rows are others to each other. A null group is a group. Keep df narrow: all its
    columns are sorted.
    """
    sound = finite(F.col(at)) & finite(F.col(slope)) & finite(F.col(height))
    own = lambda c: F.when(sound, F.col(c).cast("double"))
    rows = cut(df.select("*", own(at).alias("__at"), own(slope).alias("__m"), own(height).alias("__c"), F.lit(1).alias("__kind")))
    lines = rows.where(F.col("__at").isNotNull()).select(*within, F.col("__m").alias("slope"), F.col("__c").alias("height"), F.lit(1).cast("long").alias("copies"))
    pieces = _layers(lines, within).select(*within, F.col("start").alias("__at"), F.lit(0).alias("__kind"), F.col("first").alias("__first"), F.col("second").alias("__second"))
    both = rows.unionByName(pieces, allowMissingColumns=True)
    found = latest(both, within, ["__at", "__kind"], ["__first", "__second"]).where(F.col("__kind") == 1)
    value = lambda line: line["slope"] * F.col("__at") + line["height"]
    first: Column = F.col("__first")
    alone = (first["copies"] == 1) & (first["line"]["slope"] == F.col("__m")) & (first["line"]["height"] == F.col("__c"))
    others = F.greatest(value(first["left"]), value(first["right"]), value(F.col("__second")))
    return found.select(*df.columns, F.when(alone, others).otherwise(value(first["line"])).alias(out_col))
