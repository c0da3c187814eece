"""Quality rules with thresholds from mergeable quantile sketches per language and source.

Built-in functions only. Each text's counts are taken once and written to the shared folder; the
rest reads those. A rule looks at one ratio. Its sketch is a histogram of fixed integer bins
(a thousandth of a ratio, a hundredth of a character for word length, the last bin open), so a
sketch has a bounded size, an error of one bin, and merges by adding counts, in any order and with
the same result: partial sketches of tasks, and those of sources into languages and into all rows.

A rule's threshold in a group is the median plus SPREADS times the distance from median to the
ninth decile plus a slack (for a lower bound: minus, and to the first decile). The slack is SLACK_SPREADS times the
distance from the median to the quartile on the clean side, and at least the rule's floor: of ratios that are zero in most
documents (symbols, repeated lines and words) the quartiles say nothing, and the floor alone decides. Groups of
under MIN_GROUP rows take their language's threshold, small languages that of all rows. Rows that
fail the base rules are not in the sketches. Thresholds are joined to the rows by broadcast up to
BROADCAST_GROUPS groups, by a shuffled join beyond.

A junk tenth of a group moves its ninth decile and with it the limit. So a limit is at most (a lower one
at least) the largest (smallest) of the bounds of the group, its language and all rows: median plus
BOUND_SPREADS times the distance from the first quartile to the median plus the slack, which a junk third
moves little.

Defined cases: null is the empty text, which fails the base rules; null language or source is a
group of its own; repeated rows count each; the struct column replaces an input column of its name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ketframe.llm._common import SPACE, documents, materialize

MIN_WORDS = 50
MIN_GROUP = 100
SPREADS = 3
#: Distances from the median to the quartile on the clean side; of a normal distribution, about SPREADS to the decile.
BOUND_SPREADS = 6
SLACK_SPREADS = 12
BROADCAST_GROUPS = 500_000
SYMBOLS = "#*$%&|<>"
#: Rule -> (numerator, denominator, bins to one, last bin, least slack in bins, side).
RULES = {
    "symbols": ("n_symbols", "word_chars", 1000, 1000, 20, 1),
    "capitals": ("n_capitals", "word_chars", 1000, 1000, 50, 1),
    "dup_lines": ("n_dup_lines", "n_lines", 1000, 1000, 400, 1),
    "repeats": ("n_repeat_words", "n_words", 1000, 1000, 300, 1),
    "long_words": ("word_chars", "n_words", 100, 10_000, 100, 1),
    "short_words": ("word_chars", "n_words", 100, 10_000, 100, -1),
}
TEMP = "__ketframe_"


def _repeat_words(df: DataFrame, words: str, out: str) -> DataFrame:
    """Number of words in 3-word windows that a text has twice or more.

    Windows are sorted by hash and place; a neighbour with the same 64-bit hash is a repeat. Texts
    whose windows all differ are not sorted.
    """
    w, h, p, q, d = (F.col(words), *(F.col(TEMP + x) for x in "hpqd"))
    hashes = F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 3, F.lit(0))), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    df = df.withColumn(TEMP + "h", F.when(F.size(w) >= 3, hashes).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn(TEMP + "d", F.size(F.array_distinct(h)) < F.size(h))
    placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    df = df.withColumn(TEMP + "p", F.when(d, placed).otherwise(F.array().cast("array<struct<h: bigint, i: int>>")))
    same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
    twice = F.filter(p, lambda x, i: same(x, F.get(p, i - 1)) | same(x, F.get(p, i + 1)))
    df = df.withColumn(TEMP + "q", F.sort_array(F.transform(twice, lambda x: x["i"])))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
    step = lambda s, x: F.struct((s["n"] + 3 - F.greatest(s["to"] - x, F.lit(0))).alias("n"), (x + 3).alias("to"))
    return df.withColumn(out, F.aggregate(q, zero, step)["n"].cast("long")).drop(*(TEMP + x for x in "hpqd"))


def quality_counts(df: DataFrame, text_col: str = "text", out_col: str = "quality") -> DataFrame:
    """Add a struct of the counts the rules use."""
    text, w, lines = (F.col(TEMP + x) for x in ("text", "words", "lines"))
    out = df.withColumn(TEMP + "text", F.coalesce(F.col(text_col), F.lit("")))
    out = out.withColumn(TEMP + "words", F.filter(F.split(text, SPACE), lambda x: x != ""))
    out = out.withColumn(TEMP + "lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    out = _repeat_words(out, TEMP + "words", TEMP + "repeats")
    removed = lambda chars: (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")
    counts = F.struct(
        F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), removed(SYMBOLS).alias("n_symbols"),
        removed("ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_capitals"), F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"), F.col(TEMP + "repeats").alias("n_repeat_words"),
    )
    return out.withColumn(out_col, counts).drop(TEMP + "text", TEMP + "words", TEMP + "lines", TEMP + "repeats")


def base_failed(q: Column) -> Column:
    return (q["n_words"] < MIN_WORDS) | (100 * q["n_repeat_words"] > 50 * q["n_words"])


def _bin(q: Column, rule: str) -> Column:
    top, bottom, scale, last, _, _ = RULES[rule]
    return F.least(_div(scale * q[top], F.greatest(q[bottom], F.lit(1))), F.lit(last))


def _div(a: Column, b: Column) -> Column:
    """Whole division of non-negative longs."""
    return F.call_function("div", a, b)


def thresholds(rows: DataFrame, lang_col: str, source_col: str, quality_col: str) -> DataFrame:
    """(lang, source, rule thresholds): one row per group, merged from the rows' partial sketches."""
    q = F.col(quality_col)
    bins = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), _bin(q, r).alias("bin")) for r in RULES)))
    sketch = rows.where(~base_failed(q)).select(F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), bins.alias("b")).groupBy("lang", "source", "b.rule", "b.bin").agg(F.count("*").alias("n"))
    sketch = materialize(sketch, "sketches")

    def of(level: list[str], name: str) -> DataFrame:
        merged = sketch.groupBy(*level, "rule", "bin").agg(F.sum("n").alias("n"))
        group = merged.groupBy(*level, "rule").agg(F.sum("n").alias("rows"), F.array_sort(F.collect_list(F.struct("bin", "n"))).alias("bins"))

        def quantile(share: int, of: int = 10) -> Column:
            """The lowest bin at or below which so many tenths (or other parts) of the rows are."""
            start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("bin"))
            step = lambda s, b: F.struct((s["seen"] + b["n"]).alias("seen"), F.when(s["bin"].isNotNull(), s["bin"]).when(of * (s["seen"] + b["n"]) >= share * F.col("rows"), b["bin"]).alias("bin"))
            return F.aggregate("bins", start, step)["bin"]

        cut = group.select(*level, "rule", "rows", quantile(1).alias("q1"), quantile(5).alias("q5"), quantile(9).alias("q9"), quantile(1, 4).alias("low"), quantile(3, 4).alias("high"))
        limit = bound = F.lit(None).cast("long")
        for rule, (*_, floor, side) in RULES.items():
            clean = F.col("q5") - F.col("low") if side > 0 else F.col("high") - F.col("q5")
            far = F.col("q9") - F.col("q5") if side > 0 else F.col("q5") - F.col("q1")
            slack = F.greatest(F.lit(floor), SLACK_SPREADS * clean)
            limit = F.when(F.col("rule") == rule, F.col("q5") + side * (SPREADS * far + slack)).otherwise(limit)
            bound = F.when(F.col("rule") == rule, F.col("q5") + side * (BOUND_SPREADS * clean + slack)).otherwise(bound)
        return cut.where(F.col("rows") >= (MIN_GROUP if level else 0)).groupBy(*level).agg(F.map_from_entries(F.collect_list(F.struct("rule", F.struct(limit.alias("limit"), bound.alias("bound"))))).alias(name))

    groups = sketch.select("lang", "source").distinct()
    fine, middle, all_rows = of(["lang", "source"], "fine"), of(["lang"], "middle"), of([], "whole")
    same = lambda a, b, *on: [a[c].eqNullSafe(b[c]) for c in on]
    out = groups.join(fine, same(groups, fine, "lang", "source"), "left").select(groups["lang"], groups["source"], "fine")
    out = out.join(middle, same(out, middle, "lang"), "left").select(out["lang"], "source", "fine", "middle")
    whole = out.join(F.broadcast(all_rows), F.lit(True), "left")  # one row
    levels = ("fine", "middle", "whole")

    def of_rule(rule: str, side: int) -> Column:
        limit = F.coalesce(*(F.col(x)[rule]["limit"] for x in levels))
        bounds = [F.col(x)[rule]["bound"] for x in levels]
        return F.least(limit, F.greatest(*bounds)) if side > 0 else F.greatest(limit, F.least(*bounds))

    return whole.select("lang", "source", *(of_rule(r, side).alias(r) for r, (*_, side) in RULES.items()))


def judge(rows: DataFrame, lang_col: str = "lang", source_col: str = "source", quality_col: str = "quality") -> DataFrame:
    """Add base_failed, failed_rules and kept to the struct of counts. rows should be cheap to read twice."""
    limits = materialize(thresholds(rows, lang_col, source_col, quality_col), "thresholds")
    small = limits.count() <= BROADCAST_GROUPS
    limits = limits.select(F.struct("*").alias(TEMP + "limits"), F.col("lang").alias(TEMP + "lang"), F.col("source").alias(TEMP + "source"))
    on = F.col(lang_col).eqNullSafe(F.col(TEMP + "lang")) & F.col(source_col).eqNullSafe(F.col(TEMP + "source"))
    out = rows.join(F.broadcast(limits) if small else limits, on, "left")
    q, limit = F.col(quality_col), F.col(TEMP + "limits")
    fails = [F.when(_bin(q, r) > limit[r] if side > 0 else _bin(q, r) < limit[r], F.lit(r)) for r, (*_, side) in RULES.items()]
    base = base_failed(q)
    failed = F.array_compact(F.array(*fails))
    full = F.struct("`%s`.*" % quality_col, base.alias("base_failed"), failed.alias("failed_rules"), (~base & (F.size(failed) == 0)).alias("kept"))
    return out.withColumn(quality_col, full).drop(TEMP + "limits", TEMP + "lang", TEMP + "source")


def quality_rules(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", out_col: str = "quality") -> DataFrame:
    """df with a struct of counts and verdict: n_words, ..., base_failed, failed_rules, kept."""
    return judge(materialize(quality_counts(df, text_col, out_col), "counted"), lang_col, source_col, out_col)


def drop_rejected(df: DataFrame, **options) -> DataFrame:
    """The rows of df that the rules keep; columns as in df."""
    q = TEMP + "quality"
    return quality_rules(df, out_col=q, **options).where(F.col(q)["kept"]).drop(q)


def op7(spark, sf_dir: str) -> DataFrame:
    """Contract query: counts and verdict of every document."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", "source")
    rows = judge(materialize(quality_counts(docs).drop("text"), "counts"))
    q = F.col("quality")
    return rows.select("doc_id", *(q[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")), F.array_join(q["failed_rules"], ",").alias("failed_rules"))


def _op7_sql() -> str:
    """The same counts, bins, quantiles and thresholds in SQL; rules in the order of RULES."""
    names = list(RULES)
    bins = ", ".join(f"least({scale} * {top} // greatest({bottom}, 1), {last}) AS b_{r}" for r, (top, bottom, scale, last, *_) in RULES.items())
    long = lambda table: " UNION ALL ".join(f"SELECT r, lang, source, '{r}' AS rule, {i} AS k, b_{r} AS bin FROM {table}" for i, r in enumerate(names))
    by_rule = lambda up, down: "CASE rule " + " ".join(f"WHEN '{r}' THEN {(up if s > 0 else down).format(slack=slack)}" for r, (*_, slack, s) in RULES.items()) + " END"
    up, down = f"greatest({{slack}}, {SLACK_SPREADS} * (q5 - low))", f"greatest({{slack}}, {SLACK_SPREADS} * (high - q5))"
    cut = by_rule(f"q5 + {SPREADS} * (q9 - q5) + {up}", f"q5 - {SPREADS} * (q5 - q1) - {down}")
    bound = by_rule(f"q5 + {BOUND_SPREADS} * (q5 - low) + {up}", f"q5 - {BOUND_SPREADS} * (high - q5) - {down}")
    fails = by_rule("bin > least(cut, most)", "bin < greatest(cut, least_)")
    quantiles = ", ".join(f"min(bin) FILTER ({of} * seen >= {t} * n) AS {name}" for t, of, name in ((1, 10, "q1"), (5, 10, "q5"), (9, 10, "q9"), (1, 4, "low"), (3, 4, "high")))

    def level(name: str, by: str, least: int) -> str:
        keys = f"{by}, " if by else ""
        return f"""{name}_c AS (SELECT {keys}rule, bin, count(*) AS c FROM long GROUP BY {keys}rule, bin),
{name}_s AS (SELECT {keys}rule, bin, sum(c) OVER (PARTITION BY {keys}rule ORDER BY bin) AS seen, sum(c) OVER (PARTITION BY {keys}rule) AS n FROM {name}_c),
{name}_q AS (SELECT {keys}rule, n, {quantiles} FROM {name}_s GROUP BY {keys}rule, n),
{name} AS (SELECT {keys}rule, {cut} AS cut, {bound} AS bound FROM {name}_q WHERE n >= {least})"""

    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
three AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(generate_series(1, len(w) - 2)) AS i FROM w WHERE len(w) >= 3)),
twice AS (SELECT r, g FROM three GROUP BY r, g HAVING count(*) > 1),
hit AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM three JOIN twice USING (r, g)) GROUP BY r),
c AS (SELECT r, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(translate(t, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols,
  CAST(length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS BIGINT) AS n_capitals, CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN hit USING (r)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed, {bins} FROM c),
good AS (SELECT * FROM b WHERE NOT base_failed), long AS ({long("good")}),
{level("fine", "lang, source", MIN_GROUP)},
{level("middle", "lang", MIN_GROUP)},
{level("whole", "", 0)},
groups AS (SELECT DISTINCT lang, source FROM good),
limits AS (SELECT g.lang, g.source, w.rule, coalesce(f.cut, m.cut, w.cut) AS cut, greatest(f.bound, m.bound, w.bound) AS most, least(f.bound, m.bound, w.bound) AS least_
  FROM groups g CROSS JOIN whole w LEFT JOIN fine f ON f.rule = w.rule AND f.lang IS NOT DISTINCT FROM g.lang AND f.source IS NOT DISTINCT FROM g.source
  LEFT JOIN middle m ON m.rule = w.rule AND m.lang IS NOT DISTINCT FROM g.lang),
each AS ({long("b")}),
failed AS (SELECT r, string_agg(rule, ',' ORDER BY k) AS rules FROM (SELECT e.r, e.k, e.rule, {fails.replace("CASE rule", "CASE e.rule")} AS bad FROM each e
  JOIN limits l ON l.rule = e.rule AND l.lang IS NOT DISTINCT FROM e.lang AND l.source IS NOT DISTINCT FROM e.source) WHERE bad GROUP BY r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rules IS NULL AS kept, coalesce(rules, '') AS failed_rules FROM b LEFT JOIN failed USING (r)
"""


OP7_SQL = _op7_sql()
