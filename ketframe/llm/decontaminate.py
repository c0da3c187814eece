"""Benchmark decontamination by a prefix-filtered set join, with built-in functions only.

An item is cut into windows of `window` consecutive words (an item of fewer words is one
window). A window occurs in a document exactly where all its shingles occur in place, so by the
prefix-filter principle its rarest shingle alone must be looked up: for a required overlap of
all n tokens, n - n + 1 = 1 of them, in order of rarity, meets every match. Rarity is counted
over the whole corpus. A place that has the shingle must leave room for the words before it
(positional bound) and after it (length bound) before the words are compared one by one.

The corpus is scanned twice (counting, matching), however many windows there are, and never shuffled
as a whole: positions stay inside generated code. Up to BROADCAST_TOKENS shingles, and BROADCAST_WINDOWS
windows of BROADCAST_CHARS characters in all, a hash join looks up 64-bit shingle hashes there. Beyond,
each scan looks them up in a filter of two bits a shingle (FILTER_BUCKETS rows of 4 KB at most), and only
the places that pass, with the words about them, are shuffled to meet the shingles or windows themselves.
Matches are few and are grouped by the digest of the text, so copies of a document combine
before the shuffle.

Defined cases: a null or empty text has no words and is clean; an item without words matches
nothing; a null item id takes part in hits but is no named item; items of the same id are one
item; repeated documents each get their row; other columns pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ketframe.llm._common import ascii_lower, documents, materialize, without_keys

#: What separates words, once A-Z are in lower case.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
SHINGLE = 3
#: Most windows that are broadcast, about 300 bytes each, and most characters of their words.
BROADCAST_WINDOWS, BROADCAST_CHARS = 100_000, 30_000_000
#: Most shingle hashes that are broadcast, about 40 bytes each in memory.
BROADCAST_TOKENS = 500_000
#: Bits of the filter for each shingle, longs in one of its rows, and its most rows (a power of two).
FILTER_BITS, FILTER_LONGS, FILTER_BUCKETS = 16, 512, 16_384


def item_words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), lambda w: w != "")


def text_digest(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def _shingle(words: Column, at: Column, size: int) -> Column:
    """Hash of the shingle of `size` words from 0-based place `at` on."""
    return F.xxhash64(F.lit(size), *(F.get(words, at + j) for j in range(size)))


def _shingles(words: Column, at: Column, sizes: list[int]) -> Column:
    return F.array(*(_shingle(words, at, k) for k in sizes))


def item_windows(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(words, items): the different windows with the ids of the items that have them."""
    rows = items.select(F.col(id_col).cast("string").alias("item"), item_words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    at = F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1))))
    cut = rows.select("item", "w", at.alias("at")).select("item", F.slice("w", F.col("at"), F.lit(window)).alias("words"))
    return cut.groupBy("words").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _positions(docs: DataFrame, sizes: list[int], first: int) -> DataFrame:
    """docs (key, w) with a row for each place from `first` on, and for each size the shingle there."""
    rows = docs.withColumn("at", F.explode(F.sequence(F.lit(first), F.greatest(F.size("w") - 1, F.lit(first)))))
    if len(sizes) == 1:
        return rows.withColumn("shingle", _shingle(F.col("w"), F.col("at"), sizes[0]))
    return rows.withColumn("shingle", F.explode(_shingles(F.col("w"), F.col("at"), sizes)))


def _filter_bits(shingle: Column) -> list[Column]:
    """The two bits of a shingle within its row of the filter; the row is told by other bits of the hash."""
    return [F.shiftrightunsigned(shingle, by).bitwiseAND(F.lit(64 * FILTER_LONGS - 1)).cast("int") for by in (34, 49)]


def shingle_filter(shingles: DataFrame, count: int) -> tuple[DataFrame, int]:
    """(bucket, longs) of a Bloom filter over column shingle, and the mask that tells a shingle's bucket."""
    buckets = 1
    while buckets < FILTER_BUCKETS and buckets * 64 * FILTER_LONGS < FILTER_BITS * count:
        buckets *= 2
    rows = shingles.select(F.col("shingle").bitwiseAND(F.lit(buckets - 1)).alias("bucket"), F.explode(F.array(*_filter_bits(F.col("shingle")))).alias("bit"))
    words = rows.groupBy("bucket", F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit").bitwiseAND(F.lit(63)))).alias("bits"))
    full = words.groupBy("bucket").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("m"))
    longs = F.transform(F.sequence(F.lit(0), F.lit(FILTER_LONGS - 1)), lambda w: F.coalesce(F.try_element_at("m", w), F.lit(0).cast("long")))
    return materialize(full.select("bucket", longs.alias("longs")), "shingle-filter"), buckets - 1


def _passing(positions: DataFrame, shingles: DataFrame, count: int, told: Column) -> DataFrame:
    """The positions that are told, or whose shingle passes the filter."""
    table, mask = shingle_filter(shingles, count)
    rows = positions.withColumn("bucket", F.col("shingle").bitwiseAND(F.lit(mask))).join(F.broadcast(table), "bucket", "left")
    has = [F.call_function("shiftrightunsigned", F.get("longs", F.shiftright(bit, 6)), bit.bitwiseAND(F.lit(63))).bitwiseAND(F.lit(1)) == 1 for bit in _filter_bits(F.col("shingle"))]
    return rows.where(told | F.coalesce(has[0] & has[1], F.lit(False))).drop("bucket", "longs")


def match_windows(docs: DataFrame, items: DataFrame, *, doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """(texts, matches), both written to the shared folder.

    texts: key, n_words, one row per row of docs. matches: key, start, words, items of every
    occurrence of a window in a text; rows of copies repeat.
    """
    # 1. the windows and their shingles in place
    windows = materialize(item_windows(items, item_id, item_text, window), "windows")
    chars = F.coalesce(F.sum(F.length(F.array_join("words", "")).cast("long")), F.lit(0).cast("long"))
    known = windows.agg(F.count("*").alias("n"), chars.alias("chars"), F.collect_set(F.least(F.size("words"), F.lit(shingle))).alias("sizes")).first()
    sizes = sorted(known.sizes) or [shingle]
    corpus = docs.select(F.col(doc_text).alias("text")).select(text_digest(F.col("text")).alias("key"), item_words(F.col("text")).alias("w"))
    placed = windows.withColumn("offset", F.explode(F.sequence(F.lit(0), F.size("words") - F.least(F.size("words"), F.lit(shingle)))))
    of_size = F.lit(None).cast("long")
    for k in sizes:
        of_size = F.when(F.least(F.size("words"), F.lit(shingle)) == k, _shingle(F.col("words"), F.col("offset"), k)).otherwise(of_size)
    placed = placed.withColumn("shingle", of_size)

    # 2. rarity of the windows' shingles over the whole corpus
    tokens = materialize(placed.select("shingle").distinct(), "tokens")
    n_tokens, nothing = tokens.count(), F.lit(False)
    positions = _positions(corpus, sizes, 0)
    if n_tokens <= BROADCAST_TOKENS:
        counts = positions.join(F.broadcast(tokens), "shingle").groupBy("shingle").agg(F.count("*").alias("n"))
    else:
        counts = _passing(positions, tokens, n_tokens, nothing).groupBy("shingle").agg(F.count("*").alias("n")).join(tokens, "shingle")
    counts = materialize(counts, "rarity")
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "shingle")).alias("first")
    prefix = placed.join(counts, "shingle", "left").groupBy("words").agg(rarest, F.first("items").alias("items"))
    prefix = materialize(prefix.where("first.n > 0").select(F.col("first.shingle").alias("shingle"), F.col("first.offset").alias("offset"), "words", "items"), "prefixes")

    # 3. look up the prefix, bound, verify; the row at place -1 only tells of its text
    told, start = F.col("at") == -1, F.col("at") - F.col("offset")
    positions = _positions(corpus, sizes, -1)
    length = F.size("words")
    if known.n <= BROADCAST_WINDOWS and known.chars <= BROADCAST_CHARS:
        fits = (start >= 0) & (start + length <= F.size("w"))
        same = F.when(fits, F.slice(F.col("w"), start + 1, length) == F.col("words")).otherwise(False)
        rows = positions.join(F.broadcast(prefix), "shingle", "left").where(told | same).withColumn("n_words", F.when(told, F.size("w")))
    else:
        passing = _passing(positions, prefix, known.n, told)
        before = F.least(F.col("at"), F.lit(window - 1))
        about = F.when(told, F.array().cast("array<string>")).otherwise(F.slice("w", F.col("at") - before + 1, before + window))
        passing = passing.select("key", "at", "shingle", F.when(told, F.size("w")).alias("n_words"), before.alias("before"), about.alias("about"))
        passing = materialize(passing, "passing", packed=True)
        first = F.col("before") - F.col("offset")
        same = F.when((first >= 0) & (first + length <= F.size("about")), F.slice("about", first + 1, length) == F.col("words")).otherwise(False)
        rows = passing.where("n_words is null").join(prefix, "shingle").where(same).select("key", "at", "n_words", "offset", "words", "items")
        none = [F.lit(None).cast(kind).alias(name) for name, kind in prefix.dtypes if name != "shingle"]
        rows = rows.unionByName(passing.where("n_words is not null").select("key", "at", "n_words", *none))
    found = lambda c: F.when(F.col("n_words").isNull(), c)
    rows = rows.select("key", "n_words", found(start).alias("start"), found(length).alias("length"), found(F.col("items")).alias("items"))
    rows = materialize(rows, "matches", packed=True)
    texts = rows.where("n_words is not null").select("key", F.col("n_words").cast("long").alias("n_words"))
    return texts, rows.where("start is not null").select("key", "start", "length", "items")


def _covered(spans: Column) -> Column:
    """Number of words that sorted spans (start, end) cover."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to"))
    step = lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(s["to"], x["start"]))).alias("n"), F.greatest(s["to"], x["end"]).alias("to"))
    return F.aggregate(spans, zero, step)["n"]


def contamination(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """One row per different text of docs: key (`text_digest`), n_words, n_hit, spans, items and contaminated.

    spans are the occurring windows (start and end in words), items the ids of items with any of
    them, sorted as strings. A text is contaminated if hit words are at least a twentieth of it.
    """
    texts, matches = match_windows(docs, items, **options)
    spans = F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("length")).alias("end"))))
    hit = matches.groupBy("key").agg(spans.alias("spans"))
    named = matches.select("key", F.explode("items").alias("item")).distinct().groupBy("key").agg(F.array_sort(F.collect_list("item")).alias("items"))
    out = texts.groupBy("key").agg(F.first("n_words").alias("n_words")).join(hit, "key", "left").join(named, "key", "left")
    out = out.select("key", "n_words", F.coalesce(_covered(F.col("spans")), F.lit(0).cast("long")).alias("n_hit"), "spans", F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of docs whose texts are not contaminated; columns as in docs."""
    key = "__ketframe_key"
    bad = materialize(contamination(docs, items, doc_text=text_col, **options).where("contaminated").select(F.col("key").alias(key)), "contaminated")
    return without_keys(docs.withColumn(key, text_digest(F.col(text_col))), key, bad).drop(key)


def op8(spark, sf_dir: str) -> DataFrame:
    """Contract query: benchmark windows in every document."""
    docs, items = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = materialize(contamination(docs, items).drop("spans"), "contamination")  # so that the join of a text's copies can be split
    rows = docs.select("doc_id", text_digest(F.col("text")).alias("key")).join(found, "key")
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated")


OP8_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(len(w), 13) AS k, array_to_string(list_slice(w, a, a + least(len(w), 13) - 1), ' ') AS t
        FROM (SELECT item, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS a FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM win),
places AS (SELECT r, w, unnest(generate_series(1, len(w))) AS a FROM d WHERE len(w) > 0),
hit AS (SELECT p.r, p.a, s.k, win.item FROM places p JOIN sizes s ON p.a + s.k - 1 <= len(p.w) JOIN win ON win.k = s.k AND win.t = array_to_string(list_slice(p.w, p.a, p.a + s.k - 1), ' ')),
n AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(a, a + k - 1)) AS p FROM hit) GROUP BY r),
m AS (SELECT r, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS ids FROM hit WHERE item IS NOT NULL GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN m USING (r)
"""
