"""Line dedup by pairwise alignment.

Only lines with characters are compared. A lead is a shortest run of such lines with at least min_chars
characters, taken forwards from each line and backwards from each line; a line of that length is one by
itself. Two documents overlap if they share a lead, and each common block of min_chars characters starts
with one, so no overlap is missed, whether lines are short or stand in a document many times. Documents
are ordered by id (null ids last), then by a digest; of documents with the same lines the first stands
for all, and the others lose all of theirs.

Each pair is aligned with patience diff on line hashes: equal lines at both ends of a stretch are
aligned, lines that are unique in both anchor the rest in the longest common order (of several, the one
that ends earliest in the earlier document, and so on backwards), and what is between anchors is
aligned in the same way. A stretch without unique lines takes the n-th occurrence of a line in one for
the n-th in the other. Runs of aligned lines (blocks) with at least min_chars characters in all are
deleted from the later document. Everything is judged on the input, so a line stays in the first
document that has it.

The lines deleted are those that alignment with every earlier overlapping document would delete, but
pairs are not all aligned. A lead's rarity is the number of its places in the corpus:

1. Rare leads (up to RARE places) lead to their first holder.
2. Leads of any rarity that have not been deleted yet lead to their first holder.
3. Leads that still have not been lead to their other earlier holders, in levels of growing size (about
   one in 8 ** k of them, drawn by hash), until they are deleted or have met every earlier holder.

A lead that is deleted needs no other holder, since each deleted line is under a lead of its block. So a
line that a third of all documents share costs one pair a document where alignment finds it, which
is all but always; only leads that every holder has in another order meet all of them.

Hash arrays (12 bytes a line) are shuffled for the alignment and the text once for the cut. Both sides
of each join are written tables, not aggregates, so that a line that very many documents share, and a
document that they all lead to, are split.

Defined cases: a null text has no lines and stays null; empty lines go with the line before them, those
at the start with the first line; a text of which all is deleted becomes the empty text; rows that
agree in id and text are one document and get the same cut; the text column is replaced, other columns pass.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ketframe.llm._common import bounded_batches, documents, materialize, release, row_key

MIN_CHARS = 20
#: Most places of a rare lead.
RARE = 16
#: Each level of a lead's further holders has about so many times those of the one before.
LEVEL_BITS = 3
TEMP = "__ketframe_"
LINES = pa.struct([("hashes", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("chars", pa.int64()), ("kind", pa.binary())])
LEADS = pa.list_(pa.struct([("lead", pa.int64()), ("at", pa.int32()), ("n", pa.int32())]))


def _longest_rise(values: list[int]) -> list[int]:
    """Places of a longest strictly rising subsequence; of several, with the smallest values from the end on."""
    tails: list[int] = []
    ends: list[int] = []
    before = [0] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        before[i] = ends[k - 1] if k else -1
        if k == len(tails):
            tails.append(v)
            ends.append(i)
        else:
            tails[k], ends[k] = v, i
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def _numbered(items: list[int]) -> list[tuple[int, int]]:
    """Each item with the number of times it stood before."""
    seen: Counter = Counter()
    out = []
    for x in items:
        out.append((x, seen[x]))
        seen[x] += 1
    return out


def _anchors(a: list, b: list) -> list[tuple[int, int]]:
    """Places of items that are unique in both, by their place in b."""
    in_a, in_b = Counter(a), Counter(b)
    at = {x: i for i, x in enumerate(a) if in_a[x] == 1 and in_b.get(x) == 1}
    return [(at[x], j) for j, x in enumerate(b) if x in at]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned places (i, j) of equal items, rising in both."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        both = _anchors(a[a0:a1], b[b0:b1]) or _anchors(_numbered(a[a0:a1]), _numbered(b[b0:b1]))
        if not both:
            continue
        anchors = [(a0 + both[k][0], b0 + both[k][1]) for k in _longest_rise([i for i, _ in both])]
        out += anchors
        starts = [(a0, b0), *((i + 1, j + 1) for i, j in anchors)]
        todo += [(i0, i1, j0, j1) for (i0, j0), (i1, j1) in zip(starts, [*anchors, (a1, b1)]) if i0 < i1 and j0 < j1]
    return sorted(out)


def common_blocks(a: list[int], b: list[int], sizes: list[int], min_chars: int = MIN_CHARS) -> list[int]:
    """Lines of b in aligned blocks of min_chars characters; sizes are those of b's lines."""
    out, block = [], []
    for i, j in [*patience(a, b), (-9, -9)]:
        if block and (i, j) != (block[-1][0] + 1, block[-1][1] + 1):
            if sum(sizes[y] for _, y in block) >= min_chars:
                out += [y for _, y in block]
            block = []
        block.append((i, j))
    return out


def lead_spans(sizes: np.ndarray, min_chars: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) of the shortest runs of min_chars characters from each line forwards and backwards, each run once."""
    total = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    n = len(sizes)
    end = np.searchsorted(total, total[:-1] + min_chars)  # forwards: the least end with enough characters
    first = np.searchsorted(total, total[1:] - min_chars, "right") - 1  # backwards: the last start
    ahead, back = np.flatnonzero(end <= n), np.flatnonzero(first >= 0)
    both = np.unique(np.concatenate([ahead * (n + 1) + end[ahead], first[back] * (n + 1) + back + 1]))
    return both // (n + 1), both % (n + 1)


def lead_hashes(hashes: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each run of lines: of one line, the line's."""
    out = hashes[first].view(np.uint64).copy()
    for step in range(1, int((end - first).max(initial=1))):  # a run has at most min_chars lines
        some = first + step < end
        x = out[some] * np.uint64(0x9E3779B97F4A7C15)
        out[some] = (x ^ x >> np.uint64(29)) + hashes[first[some] + step].view(np.uint64)
    return out.view(np.int64)


def _lines():
    @F.arrow_udf("struct<hashes: array<long>, sizes: array<int>, chars: long, kind: binary>")
    def lines(texts: pa.Array) -> pa.Array:
        import xxhash

        rows = []
        for t in texts.to_pylist():
            parts = [x for x in (t or "").split("\n") if x]
            hashes = np.fromiter((xxhash.xxh64_intdigest(x.encode()) for x in parts), np.uint64, len(parts)).view(np.int64)
            sizes = np.fromiter(map(len, parts), np.int32, len(parts))
            rows.append({"hashes": hashes, "sizes": sizes, "chars": int(sizes.sum(dtype=np.int64)), "kind": xxhash.xxh3_128_digest(hashes.tobytes())})
        return pa.array(rows, LINES)

    return lines


def _leads(min_chars: int):
    @F.arrow_udf("array<struct<lead: long, at: int, n: int>>")
    def leads(hashes: pa.Array, sizes: pa.Array) -> pa.Array:
        rows = []
        for h, s in zip(hashes, sizes):
            first, end = lead_spans(s.values.to_numpy(), min_chars)
            found = lead_hashes(h.values.to_numpy(), first, end)
            rows.append([{"lead": x, "at": a, "n": n} for x, a, n in zip(found.tolist(), first.tolist(), (end - first).tolist())])
        return pa.array(rows, LEADS)

    return leads


def _aligned(min_chars: int):
    @F.arrow_udf("array<int>")
    def aligned(earlier: pa.Array, later: pa.Array, sizes: pa.Array) -> pa.Array:
        rows = zip(earlier.to_pylist(), later.to_pylist(), sizes.to_pylist())
        return pa.array([common_blocks(a, b, n, min_chars) for a, b, n in rows], pa.list_(pa.int32()))

    return aligned


def _level(lead: Column, doc: Column) -> Column:
    """Level of a holder of a lead; fewer holders have a higher one."""
    return F.floor(F.length(F.regexp_extract(F.bin(F.xxhash64(lead, doc)), "(0*)$", 1)) / LEVEL_BITS).cast("int")


def duplicate_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(key, whole, lines): by `row_key`, documents that lose lines: all, or those of these 0-based numbers among lines with characters."""
    if min_chars < 1:
        raise ValueError("a block has at least one character")
    bounded_batches(df.sparkSession)
    rows = df.select(row_key(F.col(id_col), F.col(text_col)).alias("key"), F.col(id_col).alias("id"), _lines()(F.col(text_col)).alias("l"))
    rows = rows.select("key", F.struct(F.col("id").isNull().alias("last"), "id", "key").alias("place"), "l.*").where(F.col("chars") >= min_chars)
    rows = materialize(rows, "lines", packed=True)

    # Documents with different lines, by number in their order.
    first = rows.groupBy("kind").agg(F.min("place").alias("place")).orderBy("place").select("place.key", F.monotonically_increasing_id().alias("doc"))
    first = materialize(first, "first-of-kind")
    arrays = rows.groupBy("key").agg(F.first("hashes").alias("hashes"), F.first("sizes").alias("sizes")).join(first, "key")
    once = materialize(arrays.select("doc", "hashes", "sizes", _leads(min_chars)("hashes", "sizes").alias("leads")), "lines-once")

    leads = once.select("doc", F.explode("leads").alias("l")).select("doc", "l.*")
    shared = leads.groupBy("lead").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.count("*").alias("places")).where("first < last").select("lead", "first", "places")
    shared = materialize(shared, "shared-leads", packed=True)
    left = leads.join(shared, "lead").where("doc > first")
    left = materialize(left.select("doc", "lead", "first", "places", F.sequence("at", F.col("at") + F.col("n") - 1).alias("rest")), "open-leads", packed=True)

    def align(pairs: DataFrame) -> DataFrame:
        """(doc, lines) that alignment with earlier documents deletes; pairs: doc, earlier."""
        pairs = materialize(pairs.distinct(), "pairs", packed=True)
        both = pairs.join(once.select("doc", "hashes", "sizes"), "doc")
        both = both.join(once.select(F.col("doc").alias("earlier"), F.col("hashes").alias("before")), "earlier")
        found = both.select("doc", _aligned(min_chars)("before", "hashes", "sizes").alias("lines")).where(F.size("lines") > 0)
        return materialize(found.groupBy("doc").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("lines")))).alias("lines")), "aligned")

    def still(left: DataFrame, cut: DataFrame) -> DataFrame:
        """The leads that a cut leaves something of."""
        rest = left.join(cut, "doc", "left").withColumn("rest", F.when(F.col("lines").isNull(), F.col("rest")).otherwise(F.array_except("rest", "lines"))).drop("lines")
        return materialize(rest.where(F.size("rest") > 0), "open-leads", packed=True)

    to_first = F.col("first").alias("earlier")
    cuts = [align(left.where(F.col("places") <= RARE).select("doc", to_first))]
    left = still(left, cuts[-1])
    cuts.append(align(left.where(F.col("places") > RARE).select("doc", to_first)))
    left = still(left, cuts[-1]).where("places > 2")
    if not left.isEmpty():
        held = leads.select("doc", "lead").distinct().join(left.select("lead", "first").distinct(), "lead").where("doc <> first")
        held = materialize(held.select("lead", F.col("doc").alias("earlier"), _level(F.col("lead"), F.col("doc")).alias("level")), "holders", packed=True)
        for level in sorted((r.level for r in held.select("level").distinct().collect()), reverse=True):  # 22 at most
            cuts.append(align(left.join(held.where(F.col("level") == level), "lead").where("earlier < doc").select("doc", "earlier")))
            left = still(left, cuts[-1])
            if left.isEmpty():
                break

    cut = cuts[0]
    for more in cuts[1:]:
        cut = cut.unionByName(more)
    cut = cut.groupBy("doc").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("lines")))).alias("lines"))
    part = cut.join(first, "doc").select("key", F.lit(False).alias("whole"), "lines")
    whole = rows.select("key").distinct().join(first, "key", "left_anti").select("key", F.lit(True).alias("whole"), F.lit(None).cast("array<int>").alias("lines"))
    out = materialize(part.unionByName(whole), "cuts", packed=True)
    release(once, rows, *cuts)
    return out


def cut_text(text: str, whole: bool, lines: list[int]) -> tuple[str, list[int]]:
    """What is left of a text, and the numbers of all deleted lines."""
    parts = text.split("\n")
    if whole:
        return "", list(range(len(parts)))
    gone, number, empty = set(lines), -1, 0
    kept, removed = [], []
    while empty < len(parts) and not parts[empty]:
        empty += 1
    for i, x in enumerate(parts):
        number += bool(x)
        (removed if (number if i >= empty else 0) in gone else kept).append(i)
    return "\n".join([parts[i] for i in kept]), removed


def _kept():
    @F.arrow_udf("struct<text: string, removed: array<int>>")
    def kept(texts: pa.Array, whole: pa.Array, lines: pa.Array) -> pa.Array:
        out = []
        for t, w, n in zip(texts.to_pylist(), whole.to_pylist(), lines.to_pylist()):
            out.append((t, []) if t is None or w is None else cut_text(t, w, n))
        texts, removed = zip(*out) if out else ((), ())
        return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(removed, pa.list_(pa.int32()))], names=["text", "removed"])

    return kept


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", removed_col: str | None = None, min_chars: int = MIN_CHARS) -> DataFrame:
    """df with duplicate lines deleted from the text; removed_col, if named, lists the deleted lines by number."""
    key, whole, lines, done = (TEMP + x for x in ("key", "whole", "lines", "done"))
    gone = duplicate_lines(df, id_col, text_col, min_chars).select(F.col("key").alias(key), F.col("whole").alias(whole), F.col("lines").alias(lines))
    out = df.withColumn(key, row_key(F.col(id_col), F.col(text_col))).join(gone, key, "left")
    out = out.withColumn(done, _kept()(F.col(text_col), F.col(whole), F.col(lines))).withColumn(text_col, F.col(done)["text"])
    if removed_col:
        out = out.withColumn(removed_col, F.col(done)["removed"])
    return out.drop(key, whole, lines, done)


def op4(spark, sf_dir: str) -> DataFrame:
    """Query: what line dedup leaves of every document."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = dedup_lines(docs, removed_col="removed")
    return out.select("doc_id", F.size("removed").cast("long").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"), "removed")
