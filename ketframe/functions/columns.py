"""Column expressions over state vectors and their statistics.

A real vector is array<double>; a complex one struct<re: array<double>, im: array<double>>.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """A vector of floats as doubles of norm one."""
    wide = a.cast("array<double>")
    return F.get(F.transform(F.array(norm(wide)), lambda n: F.transform(wide, lambda x: x / n)), F.lit(0))  # the norm once a row


def rounded(x: Column, digits: int = 6) -> Column:
    """Rounded, and never negative zero."""
    return F.round(x, digits) + F.lit(0.0)


def overlap(a: Column, b: Column) -> Column:
    """|<a|b>| of complex vectors."""
    re = dot(a["re"], b["re"]) + dot(a["im"], b["im"])
    im = dot(a["re"], b["im"]) - dot(a["im"], b["re"])
    return F.sqrt(re * re + im * im)


def clipped(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def fs_acos(c: Column) -> Column:
    """Fubini-Study angle of an overlap by arc cosine."""
    return F.acos(clipped(c))


def fs_stable(c: Column) -> Column:
    """The same by arc tangent, accurate for near duplicates."""
    c = clipped(c)
    return F.atan2(F.sqrt(F.greatest((1 - c) * (1 + c), F.lit(0.0))), c)


def safe_cosine(a: Column, b: Column, near_zero: float = 1e-12) -> Column:
    """struct<cosine, status>: null and the reason where a norm is near zero."""
    zero_a, zero_b = norm(a) <= near_zero, norm(b) <= near_zero
    status = F.when(zero_a & zero_b, "both_near_zero").when(zero_a, "left_near_zero").when(zero_b, "right_near_zero").otherwise("ok")
    return F.struct(F.when(~zero_a & ~zero_b, dot(a, b) / (norm(a) * norm(b))).alias("cosine"), status.alias("status"))


def magnetization_x(v: Column, n: int) -> Column:
    """<Mx> of a real state: amplitudes times those with one bit flipped."""
    at = F.sequence(F.lit(0), F.lit(2**n - 1))
    flips = [_flip(v, at, q) for q in range(n)]
    return reduce(lambda a, b: a + b, flips) / n


def _flip(v: Column, at: Column, q: int) -> Column:
    return F.aggregate(at, F.lit(0.0), lambda s, i: s + F.get(v, i) * F.get(v, i.bitwiseXOR(F.lit(1 << q))))


def magnetization_z2(v: Column, n: int) -> Column:
    """<Mz^2> of a real state: weights by the number of set bits."""
    z = lambda i: (n - 2 * F.bit_count(i)) / n
    squares = F.transform(v, lambda x, i: x * x * z(i) * z(i))
    return F.aggregate(squares, F.lit(0.0), lambda s, x: s + x)


def domain_walls(v: Column, n: int) -> Column:
    """<sum of ZZ> of a real state over the bonds of an open chain: bonds less twice those whose ends differ."""
    bonds = lambda i: n - 1 - 2 * F.bit_count(i.bitwiseXOR(F.shiftright(i, 1)).bitwiseAND(F.lit(2 ** (n - 1) - 1)))
    return F.aggregate(F.transform(v, lambda x, i: x * x * bonds(i)), F.lit(0.0), lambda s, x: s + x)


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def finite_stats(x: Column) -> list[Column]:
    """count, mean, median, population std, min and max of the finite values; null of none."""
    x = F.when(finite(x), x)
    return [F.count(x).alias("n"), F.avg(x).alias("mean"), F.median(x).alias("median"), F.stddev_pop(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max")]


def quantiles(x: Column, shares: dict[str, float]) -> list[Column]:
    """Exact quantiles with linear interpolation; all of them share one buffer."""
    every = F.percentile(x, F.array(*(F.lit(q) for q in shares.values())))
    return [F.get(every, F.lit(i)).alias(name) for i, name in enumerate(shares)]


def safe_corr(x: Column, y: Column, least: int = 3) -> Column:
    """Pearson correlation; null of fewer than `least` rows or no variance."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.when((F.count(a) >= least) & (F.stddev_pop(a) > 0) & (F.stddev_pop(b) > 0), F.corr(a, b))


def f1(hit: Column, actual: Column, predicted: Column) -> Column:
    """F1 from counts; 0 where the class never occurs."""
    return F.when(actual + predicted > 0, 2 * hit / (actual + predicted)).otherwise(F.lit(0.0))


def json_hash(*parts: Column) -> Column:
    """SHA-256 of integers and strings as a compact JSON list; strings must need no escape beyond JSON's own."""
    def told(c: Column) -> Column:
        return F.when(c.isNull(), F.lit("null")).otherwise(c.cast("string"))

    return F.sha2(F.concat(F.lit("["), F.concat_ws(",", *(told(c) for c in parts)), F.lit("]")).cast("binary"), 256)


def quoted(c: Column) -> Column:
    """A string as it stands in JSON; for json_hash."""
    plain = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), plain, F.lit('"'))
