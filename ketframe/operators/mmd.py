"""Kernel two-sample distances.

For the global kernel the mean over all pairs of |<a|b>|^2 is the trace of the product of two mean
density matrices, so each group is reduced to one d x d matrix in one pass, without any pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ketframe.functions import linalg
from ketframe.operators.pairs import to_matrix


#: Rows that a kernel of pairs meets a tile with at once.
KERNEL_ROWS = 128


def densities(states: DataFrame, group_col: str) -> DataFrame:
    """(group, n, re, im): the sum of |s><s| of each group as flat arrays, added up in two steps.

    A task sends one matrix for each group it meets, however many rows it has.
    """
    kind = dict(states.dtypes)[group_col]

    def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for frame in frames:
            for group, rows in frame.groupby(group_col):
                m = to_matrix(rows["state"]).astype(complex)
                n, total = sums.get(group, (0, 0))
                sums[group] = (n + len(rows), total + m.T @ m.conj())
        for group, (n, total) in sums.items():
            yield pd.DataFrame({"g": [group], "n": [n], "re": [total.real.ravel()], "im": [total.imag.ravel()]})

    rows = states.select(group_col, "state").mapInPandas(part, f"g {kind}, n long, re array<double>, im array<double>")
    each = rows.select("g", "n", F.posexplode(F.arrays_zip("re", "im")).alias("at", "x"))
    total = each.groupBy("g", "at").agg(F.sum("n").alias("n"), F.sum("x.re").alias("re"), F.sum("x.im").alias("im"))
    order = F.array_sort(F.collect_list(F.struct("at", "re", "im"))).alias("x")
    return total.groupBy("g").agg(F.max("n").alias("n"), order).select(F.col("g").alias("group"), "n", F.transform("x", lambda x: x["re"]).alias("re"), F.transform("x", lambda x: x["im"]).alias("im"))


def density_mmd(states: DataFrame, group_col: str) -> DataFrame:
    """(a, b, raw, mmd) of every two groups, a < b; a row for each pair of groups, not of states."""
    from ketframe.functions.columns import dot

    rho = densities(states, group_col).select("group", F.transform("re", lambda x: x / F.col("n")).alias("re"), F.transform("im", lambda x: x / F.col("n")).alias("im"))
    a = rho.select(F.col("group").alias("a"), F.col("re").alias("ar"), F.col("im").alias("ai"))
    b = rho.select(F.col("group").alias("b"), F.col("re").alias("br"), F.col("im").alias("bi"))
    real = F.zip_with("ar", "br", lambda x, y: x - y)
    imag = F.zip_with("ai", "bi", lambda x, y: x - y)
    raw = dot(real, real) + dot(imag, imag)
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", raw.alias("raw"), F.greatest(raw, F.lit(0.0)).alias("mmd"))


def kernel_mmd(left: DataFrame, right: DataFrame, group_col: str, kernel: str = "global") -> DataFrame:
    """(group, raw, mmd) between generated and target states of each group, any kernel; a group is one task."""

    def of(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        raw = linalg.mmd(to_matrix(a["state"]), to_matrix(b["state"]), kernel, clip=False) if len(a) and len(b) else None
        return pd.DataFrame({"group": [key[0]], "raw": [raw], "mmd": [None if raw is None else max(raw, 0.0)]})

    kind = dict(left.dtypes)[group_col]
    return left.groupBy(group_col).cogroup(right.groupBy(group_col)).applyInPandas(of, f"group {kind}, raw double, mmd double")


def contributions(left: DataFrame, right: DataFrame) -> DataFrame:
    """(id, contribution): rows (id, state) of two aligned sets of equal size; contributions add up to the raw MMD.

    From the mean densities: a row's share is (<g|R|g> + <t|R'|t> ...) with R the difference of the
    two means, so again no pairs of rows are made.
    """
    both = left.select("id", F.col("state").alias("g")).join(right.select("id", F.col("state").alias("t")), "id")
    tagged = both.select(F.lit("g").alias("side"), F.col("g").alias("state")).unionByName(both.select(F.lit("t").alias("side"), F.col("t").alias("state")))
    rho = {r["group"]: (np.array(r["re"]) + 1j * np.array(r["im"])) / r["n"] for r in densities(tagged, "side").collect()}  # two matrices
    if not rho:
        return both.select("id", F.lit(0.0).alias("contribution"))
    d = int(len(rho["g"]) ** 0.5)
    diff, n = (rho["g"] - rho["t"]).reshape(d, d), both.count()

    def share(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                g, t = to_matrix(f["g"]).astype(complex), to_matrix(f["t"]).astype(complex)
                value = np.einsum("bi,ij,bj->b", g.conj(), diff, g).real - np.einsum("bi,ij,bj->b", t.conj(), diff, t).real
                yield pd.DataFrame({"id": f["id"], "contribution": value / n})

    return both.mapInPandas(share, f"id {dict(left.dtypes)['id']}, contribution double")


def qubit_features(state: Column, n: int, complex_: bool = False) -> list[Column]:
    """For each qubit the Bloch vector x, y, z and sqrt(1 - |r|^2) of its reduced state, as one array of four each.

    The Uhlmann fidelity of two one-qubit states is (1 + r.s + sqrt(1 - |r|^2) sqrt(1 - |s|^2)) / 2, so a product of these.
    """
    re = state["re"] if complex_ else state
    at = F.sequence(F.lit(0), F.lit(2**n - 1))
    total = lambda of: F.aggregate(at, F.lit(0.0), lambda s, i: s + of(i))
    out = []
    for q in range(n):
        bit = F.lit(1 << q)
        sign = lambda i, bit=bit: 1 - 2 * F.least(i.bitwiseAND(bit), F.lit(1))
        flip = lambda v, i, bit=bit: F.get(v, i.bitwiseXOR(bit))
        x, y = total(lambda i: F.get(re, i) * flip(re, i)), F.lit(0.0)
        z = total(lambda i: F.get(re, i) * F.get(re, i) * sign(i))
        if complex_:
            im = state["im"]
            x = x + total(lambda i: F.get(im, i) * flip(im, i))
            y = total(lambda i: sign(i) * (F.get(re, i) * flip(im, i) - F.get(im, i) * flip(re, i)))
            z = z + total(lambda i: F.get(im, i) * F.get(im, i) * sign(i))
        out.append(F.array(x, y, z))
    return [F.concat(r, F.array(F.sqrt(F.greatest(F.lit(0.0), 1 - F.aggregate(r, F.lit(0.0), lambda s, v: s + v * v))))) for r in out]


def qubit_kernel_mmd(states: DataFrame, side_col: str, n: int, within: list[str] | None = None) -> DataFrame:
    """(within, a, b, mmd) between every two sides a < b of a group, by the mean one-qubit fidelity.

    The kernel is a product of features, so each side is 4 means a qubit, one pass without any pair.
    """
    within = within or []
    complex_ = dict(states.dtypes)["state"].startswith("struct")
    rows = states.select(*within, F.col(side_col).alias("side"), F.flatten(F.array(*qubit_features(F.col("state"), n, complex_))).alias("f"))
    means = rows.select(*within, "side", *(F.get("f", F.lit(i)).alias(f"f{i}") for i in range(4 * n))).groupBy(*within, "side").agg(*(F.avg(f"f{i}").alias(f"f{i}") for i in range(4 * n)))
    each = means.select(*within, "side", F.array(*(f"f{i}" for i in range(4 * n))).alias("m"))
    a, b = (each.select(*within, F.col("side").alias(s), F.col("m").alias(f"m{s}")) for s in "ab")
    both = (a.join(b, within) if within else a.join(b, F.lit(True))).where("a < b")  # sides of a group, not rows
    square = F.aggregate(F.zip_with("ma", "mb", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)
    return both.select(*within, "a", "b", (square / (2 * n)).alias("mmd"))


def blocked_kernel_mmd(states: DataFrame, side_col: str, kernel: str, within: list[str] | None = None, block_rows: int | None = None) -> DataFrame:
    """(within, a, b, mmd) between every two sides a < b of a group, any kernel of linalg.KERNELS.

    Block pairs send sums of the kernel by pair of sides; no row a pair and no task that holds a side.
    """
    from ketframe.operators.pairs import block_pairs

    within = within or []
    types = dict(states.dtypes)
    k = linalg.KERNELS[kernel]

    def keep(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> Iterator[pd.DataFrame]:
        left, right = left.sort_values("side", kind="stable"), right.sort_values("side", kind="stable")
        (s, at_s, n_s), (t, at_t, n_t) = (np.unique(f["side"].to_numpy(), return_index=True, return_counts=True) for f in (left, right))
        x, y = to_matrix(left["state"]), to_matrix(right["state"])
        # A few rows at a time: a kernel may hold some matrices a pair.
        values = np.add.reduceat(np.concatenate([np.add.reduceat(k(x[i : i + KERNEL_ROWS], y), at_t, 1) for i in range(0, len(x), KERNEL_ROWS)]), at_s, 0)
        rows = []
        for i, a in enumerate(s):
            for j, b in enumerate(t):
                one = (values[i, j], n_s[i] * n_t[j])
                rows += [(a, b, *one)] + ([] if same else [(b, a, *one)])
        yield pd.DataFrame({w: left[w].iloc[0] for w in within} | dict(zip(("a", "b", "total", "n"), zip(*rows))))

    kind = types[side_col]
    schema = ", ".join([*(f"{w} {types[w]}" for w in within), f"a {kind}", f"b {kind}", "total double", "n long"])
    sums = block_pairs(states.select(*within, "id", F.col(side_col).alias("side"), "state"), keep, schema, within, block_rows, [*within, "a", "b"])
    means = sums.groupBy(*within, "a", "b").agg((F.sum("total") / F.sum("n")).alias("m"))
    own = means.where("a = b")
    left, right = own.select(*within, "a", F.col("m").alias("ma")), own.select(*within, "b", F.col("m").alias("mb"))
    return means.where("a < b").join(left, [*within, "a"]).join(right, [*within, "b"]).select(*within, "a", "b", F.greatest(F.col("ma") + F.col("mb") - 2 * F.col("m"), F.lit(0.0)).alias("mmd"))
