"""Secret scan: known forms, and a randomness test battery, with built-in functions only.

Known forms are regular expressions (BASE). The battery looks at every long token and infers an
encoding from its characters; words have none, since each encoding asks for digits among letters.
Three tests compare the token's symbols with independent uniform draws from that alphabet:
chi-squared uniformity (Wilson-Hilferty), Wald-Wolfowitz runs about the alphabet's middle, and
serial correlation at lag one. Fisher's method makes one p-value of them, uniform in [0, 1] for a
random token and near 0 for others.

The null hypothesis of the tests is that a token is random; a discovery is a token taken as random, and
the false ones are others. Which tokens count is decided for each encoding and length class from the
different values of the whole corpus (copies of a value say nothing new), since short tokens have
little power. P-values above one half come from random values, so twice their number, with one more for
what is not seen, estimates how many there are; the threshold is the lowest one at which the estimated
share of others among the values at or above it is at most FALSE_SHARE. So of a class's discoveries
FALSE_SHARE are expected to be false, and of a class without random values two at most are taken. A
p-value in the lowest bin is never taken. A class of fewer than MIN_CLASS values takes the threshold of
all lengths of its encoding, a thin encoding that of all tokens. The histograms behind this are
counted with partial aggregation and have BINS bins to a class, so what reaches every task is bounded.

Positions are code points. They come from the lengths of matches and of what lies between them,
summed in blocks of BLOCK, and known forms are looked up by such blocks, so a text with very many matches
stays far from quadratic. The battery's time grows with a token's length; symbols are counted once each.

Defined cases: null is the empty text; repeated rows count each; the struct column replaces an
input column of its name, other columns pass.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ketframe.llm._common import documents, materialize

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Kind -> (pattern, group whose length counts, least length). A run of hex digits or capitals is
#: matched as a whole, so where the match itself must be long the pattern asks for the length.
BASE = {
    "assign": (ASSIGN, 2, 6),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
KINDS = (*BASE, "random")
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
DIGITS, LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
UPPER = LOWER.upper()
#: Encoding -> (alphabet, form of its tokens); the first that fits is the one.
ENCODINGS = {
    "hex": (DIGITS + LOWER[:6], r"^(?=.*[0-9])(?=.*[a-f])[0-9a-f]+$"),
    "HEX": (DIGITS + UPPER[:6], r"^(?=.*[0-9])(?=.*[A-F])[0-9A-F]+$"),
    "base32": (UPPER + "234567", r"^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+$"),
    "lower36": (DIGITS + LOWER, r"^(?=.*[0-9])(?=.*[a-z])[0-9a-z]+$"),
    "upper36": (DIGITS + UPPER, r"^(?=.*[0-9])(?=.*[A-Z])[0-9A-Z]+$"),
    "base62": (DIGITS + UPPER + LOWER, r"^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])[0-9A-Za-z]+$"),
    "base64": (UPPER + LOWER + DIGITS + "+/", r"^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])[0-9A-Za-z+/]+$"),
    "base64url": (UPPER + LOWER + DIGITS + "-_", r"^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])[0-9A-Za-z_-]+$"),
}
#: Least lengths of the length classes.
LENGTHS = (20, 28, 40, 64)
BINS = 100
FALSE_SHARE = 0.05
#: Different values below which a class takes the threshold of a wider one.
MIN_CLASS = 50
BLOCK = 256
TEMP = "__ketframe_"


def _total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0), lambda a, x: a + x)


def match_spans(df: DataFrame, text: str, pattern: str, out: str, group: int = 0) -> DataFrame:
    """Add array<struct<start, end, value>> of the pattern's leftmost matches; value is of `group`."""
    m, g, gap, step, blocks, before = (TEMP + x for x in ("m", "g", "gap", "step", "blocks", "before"))
    none = F.array().cast("array<string>")
    df = df.withColumn(m, F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)))
    any_of = F.size(m) > 0
    df = df.withColumn(g, F.when(any_of, F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(group))).otherwise(none))
    df = df.withColumn(gap, F.when(any_of, F.split(F.col(text), pattern, -1)).otherwise(none))
    df = df.withColumn(step, F.zip_with(F.slice(F.col(gap), 1, F.size(m)), F.col(m), lambda a, b: F.length(a) + F.length(b)))
    some = F.sequence(F.lit(0), F.floor((F.greatest(F.size(m), F.lit(1)) - 1) / BLOCK).cast("int"))
    df = df.withColumn(blocks, F.transform(some, lambda b: _total(F.slice(F.col(step), b * BLOCK + 1, BLOCK))))
    df = df.withColumn(before, F.transform(F.col(blocks), lambda _, b: _total(F.slice(F.col(blocks), 1, b))))

    def span(value: Column, i: Column) -> Column:
        b = F.floor(i / BLOCK).cast("int")
        start = F.get(F.col(before), b) + _total(F.slice(F.col(step), b * BLOCK + 1, i % BLOCK)) + F.length(F.get(F.col(gap), i))
        return F.struct(start.alias("start"), (start + F.length(F.get(F.col(m), i))).alias("end"), value.alias("value"))

    return df.withColumn(out, F.transform(F.col(g), span)).drop(m, g, gap, step, blocks, before)


def _phi(z: Column) -> Column:
    """Normal distribution function, within 0.0002."""
    return 1 / (1 + F.exp(-(1.5976 * z + 0.070566 * z * z * z)))


def _pick(values: dict[str, object], name: Column) -> Column:
    return reduce(lambda rest, kv: F.when(name == kv[0], F.lit(kv[1])).otherwise(rest), reversed(values.items()), F.lit(None))


def _battery(df: DataFrame, tokens: str, out: str) -> DataFrame:
    """From array<struct<start, end, value>>: array<struct<start, end, h, encoding, size, p>> of tokens with an encoding; h is the value's hash."""
    kept = lambda c, *names: [c[n].alias(n) for n in names]
    t = F.col(out)
    name = lambda v: F.coalesce(*(F.when(v.rlike(form), F.lit(n)) for n, (_, form) in ENCODINGS.items()))
    df = df.withColumn(out, F.filter(F.transform(F.col(tokens), lambda c: F.struct(*kept(c, "start", "end", "value"), F.xxhash64(c["value"]).alias("h"), name(c["value"]).alias("encoding"))), lambda c: c["encoding"].isNotNull()))

    alphabet = lambda c: _pick({n: a for n, (a, _) in ENCODINGS.items()}, c["encoding"])
    rank = lambda c: F.transform(F.split(c["value"], ""), lambda ch: F.call_function("instr", alphabet(c), ch).cast("double"))
    df = df.withColumn(out, F.transform(t, lambda c: F.struct(*kept(c, "start", "end", "h", "value", "encoding"), F.length(alphabet(c)).cast("double").alias("k"), rank(c).alias("v"))))

    n = lambda c: F.size(c["v"]).cast("double")
    total = lambda array, f: F.aggregate(array, F.lit(0.0), lambda a, x: a + f(x))
    count = lambda c, ch: F.length(c["value"]) - F.length(F.replace(c["value"], ch, F.lit("")))
    squares = lambda c: total(F.array_distinct(F.split(c["value"], "")), lambda ch: count(c, ch).cast("double") * count(c, ch))
    pairs = lambda c: F.zip_with(F.slice(c["v"], 1, F.size(c["v"]) - 1), F.slice(c["v"], 2, F.size(c["v"]) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    high = lambda c, x: x > c["k"] / 2
    df = df.withColumn(out, F.transform(t, lambda c: F.struct(
        *kept(c, "start", "end", "h", "encoding", "k", "v"), n(c).alias("n"), squares(c).alias("squares"), pairs(c).alias("pairs"),
        (total(c["v"], lambda x: x) / n(c)).alias("mean"), total(c["v"], lambda x: high(c, x).cast("double")).alias("above"),
    )))
    df = df.withColumn(out, F.transform(t, lambda c: F.struct(
        *kept(c, "start", "end", "h", "encoding", "k", "n", "squares", "above"),
        total(c["v"], lambda x: (x - c["mean"]) * (x - c["mean"])).alias("ss"), total(c["pairs"], lambda x: (x["a"] - c["mean"]) * (x["b"] - c["mean"])).alias("sp"),
        (1 + total(c["pairs"], lambda x: (high(c, x["a"]) != high(c, x["b"])).cast("double"))).alias("runs"),
    )))

    def p(c: Column) -> Column:
        df_ = c["k"] - 1
        x2 = c["k"] / c["n"] * c["squares"] - c["n"]
        chi = 1 - _phi((F.pow(F.greatest(x2, F.lit(0.0)) / df_, F.lit(1 / 3)) - (1 - 2 / (9 * df_))) / F.sqrt(2 / (9 * df_)))
        both = 2 * c["above"] * (c["n"] - c["above"])
        mu = both / c["n"] + 1
        var = both * (both - c["n"]) / (c["n"] * c["n"] * (c["n"] - 1))
        two_sided = lambda z: 2 * (1 - _phi(F.abs(z)))
        runs = F.when(var > 0, two_sided((c["runs"] - mu) / F.sqrt(F.greatest(var, F.lit(1e-9))))).otherwise(F.lit(0.0))
        serial = F.when(c["ss"] > 0, two_sided((c["sp"] / F.greatest(c["ss"], F.lit(1e-9)) + 1 / c["n"]) * F.sqrt(c["n"]))).otherwise(F.lit(0.0))
        half = -sum((F.log(F.greatest(x, F.lit(1e-12))) for x in (chi, runs, serial)), F.lit(0.0))
        return F.exp(-half) * (1 + half + half * half / 2)  # upper tail of chi-squared with 6 degrees of freedom

    size = lambda c: reduce(lambda rest, low: F.when(c["n"] >= low, F.lit(low)).otherwise(rest), LENGTHS, F.lit(0))
    return df.withColumn(out, F.transform(t, lambda c: F.struct(*kept(c, "start", "end", "h", "encoding"), size(c).alias("size"), p(c).alias("p"))))


def scan_rows(df: DataFrame, text_col: str = "text", out_col: str = "secrets") -> DataFrame:
    """Add struct<base: array<struct<start, kind, end>>, tokens: array<...>>, one scan of the text."""
    text, names = TEMP + "text", {k: TEMP + k for k in (*BASE, "token")}
    out = df.withColumn(text, F.coalesce(F.col(text_col), F.lit("")))
    for kind, (pattern, group, least) in BASE.items():
        out = match_spans(out, text, pattern, names[kind], group)
        out = out.withColumn(names[kind], _of_kind(_long(F.col(names[kind]), least), kind))
    out = _battery(match_spans(out, text, TOKEN, names["token"]), names["token"], TEMP + "tested")
    base = F.array_sort(F.concat(*(F.col(names[k]) for k in BASE)))
    return out.withColumn(out_col, F.struct(base.alias("base"), F.col(TEMP + "tested").alias("tokens"))).drop(text, TEMP + "tested", *names.values())


def _long(spans: Column, least: int) -> Column:
    return F.filter(spans, lambda s: F.length(s["value"]) >= least)


def _of_kind(spans: Column, kind: str) -> Column:
    number = F.lit(KINDS.index(kind))
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), number.alias("kind"), s["end"].alias("end")))


def random_thresholds(rows: DataFrame, secrets_col: str = "secrets") -> DataFrame:
    """(encoding, size, least): from which p-value on the tokens of a class count as random; null: none does."""
    token = rows.select(F.explode(F.col(secrets_col)["tokens"]).alias("t")).select("t.encoding", "t.size", "t.h", "t.p")
    values = token.groupBy("encoding", "size", "h").agg(F.min("p").alias("p"))
    bins = values.groupBy("encoding", "size", F.least(F.floor(F.col("p") * BINS), F.lit(BINS - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    bins = materialize(bins, "p-values")

    def level(name: str, *keys: str) -> DataFrame:
        """(keys, name): struct<total, least> of each class."""
        merged = bins.groupBy(*keys, "bin").agg(F.sum("n").alias("n"))
        upper = F.sum(F.when(F.col("bin") >= BINS // 2, F.col("n")).otherwise(0)).alias("upper")
        classes = merged.groupBy(*keys).agg(F.sum("n").alias("total"), upper, F.collect_list(F.struct("bin", "n")).alias("bins"))
        found = lambda least: F.aggregate(F.filter("bins", lambda b: b["bin"] >= least), F.lit(0).cast("long"), lambda a, b: a + b["n"])
        enough = lambda least: found(least) * (1 - FALSE_SHARE) <= 2 * (F.col("upper") + 1) * (BINS - least) / BINS
        least = F.get(F.filter(F.sequence(F.lit(1), F.lit(BINS // 2)), enough), F.lit(0)) / BINS
        return classes.select(*keys, F.struct("total", least.alias("least")).alias(name))

    out = level("fine", "encoding", "size").join(level("middle", "encoding"), "encoding").join(F.broadcast(level("whole")))  # one row
    wide = F.when(F.col("middle.total") >= MIN_CLASS, F.col("middle.least")).otherwise(F.col("whole.least"))
    return out.select("encoding", "size", F.when(F.col("fine.total") >= MIN_CLASS, F.col("fine.least")).otherwise(wide).alias("least"))


def judge(rows: DataFrame, secrets_col: str = "secrets") -> DataFrame:
    """Replace the scan's struct by array<struct<start, kind, end>> of all spans, in order; rows are read twice."""
    limits = random_thresholds(rows, secrets_col).where("least is not null").collect()  # at most one row per encoding and length class
    s, blocks = F.col(secrets_col), TEMP + "blocks"
    some = F.sequence(F.lit(0), F.floor((F.greatest(F.size(s["base"]), F.lit(1)) - 1) / BLOCK).cast("int"))
    part = F.transform(some, lambda b: F.slice(s["base"], b * BLOCK + 1, BLOCK))
    rows = rows.withColumn(blocks, F.transform(part, lambda p: F.struct(F.array_min(F.transform(p, lambda b: b["start"])).alias("start"), F.array_max(F.transform(p, lambda b: b["end"])).alias("end"), p.alias("spans"))))
    meet = lambda b, t: (b["start"] < t["end"]) & (t["start"] < b["end"])
    # named twice, so that the optimizer keeps the column instead of making it anew for each token
    known = lambda t: (F.size(blocks) > 0) & F.coalesce(F.exists(F.col(blocks), lambda b: meet(b, t) & F.exists(b["spans"], lambda x: meet(x, t))), F.lit(False))
    least = lambda t: reduce(lambda rest, x: F.when((t["encoding"] == x["encoding"]) & (t["size"] == x["size"]), F.lit(float(x["least"]))).otherwise(rest), limits, F.lit(None).cast("double"))
    random = _of_kind(F.filter(s["tokens"], lambda t: F.coalesce(t["p"] >= least(t), F.lit(False)) & ~known(t)), "random")
    return rows.withColumn(secrets_col, F.array_sort(F.concat(s["base"], random))).drop(blocks)


def find_secrets(df: DataFrame, text_col: str = "text", out_col: str = "secrets") -> DataFrame:
    """df with array<struct<kind, start, end>> of secrets, by start and then kind; ends are exclusive."""
    rows = judge(materialize(scan_rows(df, text_col, out_col), "secrets"), out_col)
    named = lambda s: F.struct(_pick({i: k for i, k in enumerate(KINDS)}, s["kind"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    return rows.withColumn(out_col, F.transform(F.col(out_col), named))


def _told(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", _pick({i: k for i, k in enumerate(KINDS)}, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1(spark, sf_dir: str) -> DataFrame:
    """Contract query: secrets of every document."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    rows = judge(materialize(scan_rows(docs).drop("text"), "scanned"))
    s = F.col("secrets")
    of = lambda kind: F.filter(s, lambda x: x["kind"] == KINDS.index(kind))
    base = F.filter(s, lambda x: x["kind"] < len(BASE))
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return rows.select("doc_id", *counts, F.sha2(_told(base).cast("binary"), 256).alias("base_sha256"), _told(s).alias("spans"))
