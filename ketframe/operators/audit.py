"""Group statistics, distribution tests and decisions over rows of results."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ketframe.functions import columns as C
from ketframe.operators import ranks
from ketframe.operators.pairs import block_pairs, to_matrix
from ketframe.operators.rounds import cut


def cosine_groups(states: DataFrame) -> DataFrame:
    """(same_class, pairs, mean, positive, negative) over all pairs; a block pair sends two rows of sums."""

    def keep(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> Iterator[pd.DataFrame]:
        c = to_matrix(left["state"]) @ to_matrix(right["state"]).T
        agree = left["label"].to_numpy()[:, None] == right["label"].to_numpy()[None]
        if same:
            upper = np.triu_indices(len(left), 1)
            c, agree = c[upper], agree[upper]
        of = lambda v, k: int(np.count_nonzero(v & agree) if k else np.count_nonzero(v) - np.count_nonzero(v & agree))
        up, down, every, s = c > 0, c < 0, np.ones(c.shape, bool), float(c.sum())
        own = float((c * agree).sum())
        rows = [(k, of(every, k), own if k else s - own, of(up, k), of(down, k)) for k in (True, False)]
        yield pd.DataFrame(rows, columns=["same_class", "n", "s", "up", "down"])

    out = block_pairs(states.select("id", "label", "state"), keep, "same_class boolean, n long, s double, up long, down long", sums=["same_class"])
    n = F.sum("n")
    return out.groupBy("same_class").agg(n.alias("pairs"), (F.sum("s") / n).alias("mean"), (F.sum("up") / n).alias("positive"), (F.sum("down") / n).alias("negative")).where("pairs > 0")


def binary_scores(rows: DataFrame, group: str, actual: str, predicted: str, score: str) -> DataFrame:
    """(group, n, loss, accuracy, macro_f1) of 0/1 predictions; the loss is of the score against -1 or 1."""
    y, p = F.col(actual), F.col(predicted)
    n = F.count("*")
    f1 = [C.f1(F.count_if((y == c) & (p == c)), F.count_if(y == c), F.count_if(p == c)) for c in (0, 1)]
    return rows.groupBy(group).agg(n.alias("n"), F.avg((F.col(score) - (2 * y - 1)) ** 2).alias("loss"), (F.count_if(y == p) / n).alias("accuracy"), ((f1[0] + f1[1]) / 2).alias("macro_f1"))


def ks(rows: DataFrame, group: str, value: str, baseline) -> DataFrame:
    """(group, statistic): two-sample Kolmogorov-Smirnov of each group against the baseline group.

    Between two of a group's own values its share stays and the baseline's only grows, so the largest difference is at
    one of the group's values or right before one. Hence each distinct value needs the baseline's running count
    there, one running sum over all distinct values, and no group meets the baseline's values.
    """
    counts = cut(rows.where(C.finite(F.col(value))).groupBy(F.col(group).alias("g"), F.col(value).alias("x")).agg(F.count("*").alias("n")))
    sizes = counts.groupBy("g").agg(F.sum("n").alias("size"))
    base = counts.groupBy("x").agg(F.coalesce(F.sum(F.when(F.col("g") == baseline, F.col("n"))), F.lit(0)).alias("m"))
    base = ranks.running_sums(base, [], ["x"], {"to": F.col("m")}).select("x", "m", "to")
    own = ranks.running_sums(counts.where(F.col("g") != baseline), ["g"], ["x"], {"upto": F.col("n")})
    whole = sizes.where(F.col("g") == baseline).agg(F.max("size").alias("whole"))  # one row
    at = own.join(base, "x").join(sizes, "g").join(F.broadcast(whole), F.lit(True))
    here = F.abs(F.col("upto") / F.col("size") - F.col("to") / F.col("whole"))
    before = F.abs((F.col("upto") - F.col("n")) / F.col("size") - (F.col("to") - F.col("m")) / F.col("whole"))
    return at.groupBy(F.col("g").alias("group")).agg(F.max(F.greatest(here, before)).alias("statistic"))


def robust_floor(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, largest, median, mad, bound): bound = max(largest, median + 6 * 1.4826 * MAD)."""
    x = F.col(value)
    middle = rows.groupBy(group).agg(F.median(x).alias("median"), F.max(x).alias("largest"))
    mad = rows.join(middle, group).groupBy(group).agg(F.first("median").alias("median"), F.first("largest").alias("largest"), F.median(F.abs(x - F.col("median"))).alias("mad"))
    return mad.select(F.col(group).alias("group"), "largest", "median", "mad", F.greatest("largest", F.col("median") + 6 * 1.4826 * F.col("mad")).alias("bound"))


def isolated_gap(rows: DataFrame, group: str, value: str, ratio: float = 10.0, share: float = 0.1) -> DataFrame:
    """(group, below, above, threshold): the largest ratio between neighbouring distinct positive values.

    threshold, their geometric mean, is null unless the ratio is large enough and the gap low enough.
    """
    x = rows.where(F.col(value) > 0).select(F.col(group).alias("group"), F.col(value).alias("x")).distinct()
    gaps = ranks.following(x, ["group"], ["x"], "x", "y").where("y is not null").groupBy("group").agg(F.max(F.struct((F.col("y") / F.col("x")).alias("r"), (-F.col("x")).alias("nx"), "x", "y")).alias("g"))
    low = x.groupBy("group").agg(F.percentile("x", F.lit(share)).alias("low"))
    good = (F.col("g.r") >= ratio) & (F.col("g.x") <= F.col("low"))
    return gaps.join(low, "group").select("group", F.col("g.x").alias("below"), F.col("g.y").alias("above"), F.when(good, F.sqrt(F.col("g.x") * F.col("g.y"))).alias("threshold"))


def spearman(rows: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """(group, n, spearman): Pearson of average ranks; values are ranked by counting, so ties are rows of a count."""
    both = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(group).alias("group"), F.col(x).alias("x"), F.col(y).alias("y"))
    out = ranks.average_ranks(ranks.average_ranks(both, ["group"], "x", "rx"), ["group"], "y", "ry")
    return out.groupBy("group").agg(F.count("*").alias("n"), C.safe_corr(F.col("rx"), F.col("ry")).alias("spearman"))


def paired_deltas(rows: DataFrame, keys: list[str], arm: str, value: str, baseline: str, arms: list[str]) -> DataFrame:
    """keys, arm, value, baseline value and delta: arms pivoted beside each other for each key."""
    wide = rows.groupBy(*keys).pivot(arm, [baseline, *arms]).agg(F.avg(value))
    each = F.explode(F.array(*(F.struct(F.lit(a).alias("arm"), F.col(f"`{a}`").alias("value")) for a in arms)))
    long = wide.select(*keys, F.col(f"`{baseline}`").alias("base"), each.alias("x")).select(*keys, "x.arm", "x.value", "base")
    return long.where("value is not null and base is not null").withColumn("delta", F.col("value") - F.col("base"))


def win_tie_loss(deltas: DataFrame, group: str, delta: str = "delta", tolerance: float = 0.0) -> DataFrame:
    """(group, n, mean, std, wins, ties, losses); the sample standard deviation."""
    d = F.col(delta)
    return deltas.groupBy(group).agg(F.count("*").alias("n"), F.avg(d).alias("mean"), F.stddev_samp(d).alias("std"), F.count_if(d > tolerance).alias("wins"), F.count_if(F.abs(d) <= tolerance).alias("ties"), F.count_if(d < -tolerance).alias("losses"))


def leave_one_out(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, n, mean) of all rows but the group's, from sums: nothing is joined to other groups."""
    each = rows.groupBy(group).agg(F.count(value).alias("n"), F.sum(value).alias("s"))
    total = each.agg(F.sum("n").alias("all_n"), F.sum("s").alias("all_s"))  # one row
    out = each.join(F.broadcast(total), F.lit(True))
    n = F.col("all_n") - F.col("n")
    return out.select(F.col(group).alias("group"), n.alias("n"), F.when(n > 0, (F.col("all_s") - F.col("s")) / n).alias("mean"))


def distribution_shift(rows: DataFrame, group: str, sample: str, value: str) -> DataFrame:
    """(group, mean_shift, variance_ratio, overlap): the drawn rows (sample is true) against all others of a group."""
    x, s = F.col(value), F.col(sample)
    a, b = F.when(~s, x), F.when(s, x)
    agg = rows.groupBy(F.col(group).alias("group")).agg(
        F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.stddev_pop(a).alias("sa"), F.var_pop(a).alias("va"), F.var_pop(b).alias("vb"),
        F.min(a).alias("la"), F.max(a).alias("ha"), F.min(b).alias("lb"), F.max(b).alias("hb"),
    )
    shift = F.when(F.col("sa") > 0, F.abs(F.col("mb") - F.col("ma")) / F.col("sa"))
    return agg.select("group", shift.alias("mean_shift"), F.when(F.col("va") > 0, F.col("vb") / F.col("va")).alias("variance_ratio"), (F.greatest("la", "lb") <= F.least("ha", "hb")).alias("overlap"))


def gate_status(checks: DataFrame, group: str, name: str, passed: str) -> DataFrame:
    """(group, status, blocking): PASS or BLOCKED with the names of failed or missing checks."""
    bad = F.array_sort(F.collect_list(F.when(~F.coalesce(F.col(passed), F.lit(False)), F.col(name))))
    return checks.groupBy(F.col(group).alias("group")).agg(bad.alias("blocking")).select("group", F.when(F.size("blocking") == 0, "PASS").otherwise("BLOCKED").alias("status"), "blocking")


def overlap_counts(frames: dict[str, DataFrame], key: str) -> DataFrame:
    """(a, b, shared): keys that two sets share, for each two sets, from one grouped pass."""
    names = sorted(frames)
    rows = None
    for i, n in enumerate(names):
        part = frames[n].select(F.col(key).cast("string").alias("key"), F.lit(i).alias("set")).where("key is not null").distinct()
        rows = part if rows is None else rows.unionByName(part)
    held = rows.groupBy("key").agg(F.array_sort(F.collect_set("set")).alias("sets")).groupBy("sets").agg(F.count("*").alias("n"))
    two = [(i, j) for i in range(len(names)) for j in range(i + 1, len(names))]
    counts = [F.sum(F.when(F.array_contains("sets", i) & F.array_contains("sets", j), F.col("n")).otherwise(0)).alias(f"c{i}_{j}") for i, j in two]
    one = held.agg(*counts)
    each = F.explode(F.array(*(F.struct(F.lit(names[i]).alias("a"), F.lit(names[j]).alias("b"), F.coalesce(f"c{i}_{j}", F.lit(0)).cast("long").alias("shared")) for i, j in two)))
    return one.select(each.alias("x")).select("x.*")


def decide(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """rows with a boolean for each named check, the failed ones, and GO or NO-GO."""
    names = list(checks)
    out = rows.withColumns(checks)
    failed = F.array_compact(F.array(*(F.when(~F.coalesce(F.col(n), F.lit(False)), F.lit(n)) for n in names)))
    return out.withColumn("failed", failed).withColumn("decision", F.when(F.size("failed") == 0, "GO").otherwise("NO-GO"))
