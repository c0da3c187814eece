"""Substring dedup by prefix-partitioned suffix trees.

A window is `length` consecutive words of one text; words under a window that
also starts elsewhere are removed. The tree of all suffixes is never built in
one place:

1. Texts are reduced to distinct ones with their number of copies. All windows
   of a text with copies repeat, and one of the copies stands for the others.
2. Of each window one suffix is looked up: the one whose first PREFIX words
   have the smallest hash in the window. Equal windows choose the same one, and
   neighbouring windows mostly share it, so the windows of a text fall into
   runs, each filed under its prefix with the words it covers (a segment). A
   prefix with one run in the corpus is a leaf and goes no further; the others
   are dealt out to buckets that fit in memory.
3. A prefix with more segments than a group may hold is lengthened to the whole
   window: its windows are counted one by one in a grouped aggregate. At most
   MOST_LONG prefixes are, the most frequent ones, so the list of them is
   bounded and can be sent to all tasks.
4. In a bucket, segments are merged where equal, and the subtree of each prefix
   is built downwards by doubling: ranks of words are its nodes at depth 1, pairs
   of nodes at depth d those at depth 2d, up to the depth of a window. A node at
   that depth with two suffixes below is a deep internal node; runs of such
   windows in a text are its maximal repeats.
5. Repeats return to their texts as word intervals, joined by the text's digest.

Words are compared by 64-bit hashes, all of a window's words at a time; texts and
lengthened prefixes by 128-bit digests.

Defined cases: a null text has no words and keeps the empty text; a text with
fewer words than a window keeps all, joined by one space; repeated rows count as
copies; other columns pass, output columns replace input columns of their name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ketframe.llm._common import bounded_batches, documents, materialize

WINDOW = 35
PREFIX = 8
#: Segments of one prefix beyond which it is lengthened.
GROUP_SEGMENTS = 20_000
#: Most prefixes that are lengthened; 8 bytes each.
MOST_LONG = 1_000_000
#: Windows of lengthened prefixes that are broadcast at once, about 100 bytes each; more are joined by a shuffle.
BROADCAST_WINDOWS = 200_000
#: Words worked on at a time.
BLOCK_WORDS = 1_000_000
#: Buckets to a shuffle partition; a task holds one bucket at a time.
BUCKETS_EACH = 2

_ODD = np.array([(2 * i + 1) * 0x9E3779B97F4A7C15 % 2**64 | 1 for i in range(512)], np.uint64)


class Block:
    """Some texts as word codes, with the runs of their windows."""

    def __init__(self, keys: list[bytes], copies: list[int], texts: list[bytes], length: int, prefix: int):
        import xxhash

        table: dict[bytes, int] = _Codes()
        rows = [np.fromiter(map(table.__getitem__, words), np.int32, len(words)) for words in map(bytes.split, texts)]
        self.keys, self.copies = keys, copies
        self.code = np.concatenate(rows) if rows else np.zeros(0, np.int32)
        self.hash_of = np.fromiter(map(xxhash.xxh64_intdigest, table), np.uint64, len(table))
        sizes = np.array([len(r) for r in rows], np.int64)
        self.first = np.cumsum(sizes) - sizes
        self._runs(sizes, length, prefix)

    def _runs(self, sizes: np.ndarray, length: int, prefix: int) -> None:
        """low, count, anchor, key and text of each run: `count` windows from word `low` on that share the suffix at `anchor`."""
        n, many = len(self.code), np.maximum(sizes - length + 1, 0)
        starts = np.repeat(self.first - (np.cumsum(many) - many), many) + np.arange(many.sum())
        if not len(starts):
            self.low = self.count = self.anchor = self.text = np.zeros(0, np.int64)
            self.key = np.zeros(0, np.uint64)
            return
        gram = prefix_hash(self.hash_of[self.code], prefix)
        place = np.uint64((1 << max(1, n.bit_length())) - 1)
        least = sliding_min((gram & ~place) | np.arange(len(gram), dtype=np.uint64), length - prefix + 1)
        anchor = (least[starts] & place).astype(np.int64)
        cut = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        self.low, self.anchor = starts[cut], anchor[cut]
        self.count = np.diff(np.append(cut, len(starts)))
        self.key = gram[self.anchor]
        self.text = np.searchsorted(self.first, self.low, "right") - 1


class _Codes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = code = len(self)
        return code


def prefix_hash(words: np.ndarray, prefix: int) -> np.ndarray:
    """A mixed 64-bit hash of the `prefix` words from each word on."""
    n = len(words) - prefix + 1
    out = np.zeros(n, np.uint64)
    for j in range(prefix):
        out += words[j : j + n] * _ODD[j]
    out ^= out >> np.uint64(33)
    out *= np.uint64(0xFF51AFD7ED558CCD)
    out ^= out >> np.uint64(33)
    out *= np.uint64(0xC4CEB9FE1A85EC53)
    return out ^ out >> np.uint64(33)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of `width` values from each place on."""
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... of size[0] numbers, then the same of the next."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _blocks(batches: Iterator[pa.RecordBatch], length: int, prefix: int) -> Iterator[Block]:
    """Rows (key, text, copies and maybe repeated prefixes) in blocks of about BLOCK_WORDS words; a longer text is a block of its own."""
    keys, copies, texts, inner, held = [], [], [], [], 0

    def block() -> Block:
        out = Block(keys, copies, texts, length, prefix)
        out.inner = np.unique(np.concatenate(inner)).astype(np.int64).view(np.uint64) if inner else None
        return out

    for batch in batches:
        found = batch.column(3) if batch.num_columns > 3 else None
        for i, (key, text, n) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist())):
            data = text.as_buffer().to_pybytes() if text.is_valid else b""
            keys.append(key), copies.append(min(n, 2)), texts.append(data)
            if found is not None:
                inner.append(found[i].values.to_numpy(zero_copy_only=False))
            held += len(data)
            if held >= 6 * BLOCK_WORDS:
                yield block()
                keys, copies, texts, inner, held = [], [], [], [], 0
    if keys:
        yield block()


def pack(block: Block, run: np.ndarray, length: int) -> bytes:
    """The segments of some runs of a block, with all a bucket needs to build its subtrees."""
    import pickle

    import zstandard

    size = block.count[run] + length - 1
    code = block.code[spread(block.low[run], size)]
    if 8 * len(code) < len(block.hash_of):
        used, code = np.unique(code, return_inverse=True)
    else:
        mark = np.zeros(len(block.hash_of), bool)
        mark[code] = True
        used = np.flatnonzero(mark)
        code = (np.cumsum(mark, dtype=np.int32) - 1)[code]
    texts, text = np.unique(block.text[run], return_inverse=True)
    data = {
        "words": block.hash_of[used].tobytes(), "code": code.astype(np.uint16 if len(used) < 65_536 else np.uint32),
        "count": block.count[run].astype(np.uint16), "anchor": (block.anchor[run] - block.low[run]).astype(np.uint16),
        "at": (block.low[run] - block.first[block.text[run]]).astype(np.uint32), "text": text.astype(np.uint32),
        "keys": b"".join(block.keys[t] for t in texts), "copies": np.array([block.copies[t] for t in texts], np.uint8),
    }
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(data, protocol=5))


def unpack(blobs: list[bytes]) -> dict[str, np.ndarray]:
    """All segments of a bucket; word ranks are common to them."""
    import pickle

    import zstandard

    parts = [pickle.loads(zstandard.ZstdDecompressor().decompress(b)) for b in blobs]
    words = [np.frombuffer(p["words"], np.uint64) for p in parts]
    hashes, rank = np.unique(np.concatenate(words), return_inverse=True)
    at = np.cumsum([0] + [len(w) for w in words])
    texts = np.cumsum([0] + [len(p["copies"]) for p in parts])
    out = {k: np.concatenate([p[k] for p in parts]).astype(np.int64) for k in ("count", "anchor", "at", "copies")}
    out["rank"] = np.concatenate([rank[a : a + len(w)][p["code"]] for a, w, p in zip(at, words, parts)]).astype(np.int32)
    out["text"] = np.concatenate([t + p["text"].astype(np.int64) for t, p in zip(texts, parts)])
    return out | {"hashes": hashes, "keys": np.frombuffer(b"".join(p["keys"] for p in parts), np.uint8).reshape(-1, 16)}


def deep_nodes(rank: np.ndarray, size: np.ndarray, weight: np.ndarray, length: int) -> np.ndarray:
    """Which windows of some different segments (in a row) are below a node at depth `length` with weight 2 or more.

    weight: the number of occurrences of each segment.
    """
    n, end = len(rank), np.repeat(np.cumsum(size), size)
    node, depth = rank.astype(np.int64), 1

    def joined(node: np.ndarray, depth: int, step: int) -> np.ndarray:
        """Nodes at depth `depth + step` of the suffixes that are long enough."""
        at = np.flatnonzero(np.arange(n) + depth + step <= end)
        out = np.zeros(n, np.int64)
        out[at] = np.unique(node[at] * (int(node.max()) + 1) + node[at + step], return_inverse=True)[1]
        return out

    while 2 * depth <= length:
        node, depth = joined(node, depth, depth), 2 * depth
    if depth < length:
        node, depth = joined(node, depth, length - depth), length
    windows = spread(np.cumsum(size) - size, size - length + 1)
    below = np.bincount(node[windows], weights=np.repeat(weight, size - length + 1))
    return below[node[windows]] >= 2


def repeated_windows(seg: dict[str, np.ndarray], length: int, prefix: int) -> np.ndarray:
    """For every window of every segment (in a row), whether it starts anywhere else."""
    size = seg["count"] + length - 1
    first = np.cumsum(size) - size
    word = seg["hashes"][seg["rank"]]
    key = np.zeros(len(size), np.uint64)
    for j in range(prefix):
        key += word[first + seg["anchor"] + j] * _ODD[j]
    place = np.arange(len(word)) - np.repeat(first, size)
    same = np.empty((len(size), 4), np.uint64)
    same[:, 0], same[:, 1] = key, size
    same[:, 2] = np.add.reduceat(word * _ODD[place % 512], first)
    same[:, 3] = np.add.reduceat((word ^ word >> np.uint64(29)) * _ODD[511 - place % 512], first)
    order = np.lexsort(same.T[::-1])
    new = np.concatenate([[True], (same[order][1:] != same[order][:-1]).any(1)])
    kind = np.empty(len(size), np.int64)  # equal segments are of one kind
    kind[order] = np.cumsum(new) - 1
    one = order[new]  # a segment of each kind; kinds are in the order of their prefixes
    weight = np.bincount(kind, weights=seg["copies"][seg["text"]])
    fresh = np.concatenate([[True], key[one][1:] != key[one][:-1]])
    group = np.cumsum(fresh) - 1
    mixed = np.bincount(group)[group] > 1  # a prefix with different segments needs its subtree
    # windows of each kind, alone under its prefix: all repeat or none
    windows = seg["count"][one]
    offset = np.cumsum(windows) - windows
    found = np.repeat((weight >= 2) & ~mixed, windows)
    if mixed.any():
        some = one[mixed]
        found[spread(offset[mixed], windows[mixed])] = deep_nodes(seg["rank"][spread(first[some], size[some])], size[some], weight[mixed], length)
    return found[spread(offset[kind], seg["count"])]


def merged(row: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, from, to) of the words under windows; both inputs are sorted together."""
    cut = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (start[1:] > start[:-1] + length)]))
    last = np.append(cut[1:], len(row)) - 1
    return row[cut], start[cut], start[last] + length


FOUND = pa.schema([("key", pa.binary()), ("spans", pa.binary())])


def _intervals(blobs: list[bytes], length: int, prefix: int) -> pa.RecordBatch | None:
    """Rows (key, spans) of a bucket: int32 pairs of the first and the next word of each repeat."""
    seg = unpack(blobs)
    hit = np.flatnonzero(repeated_windows(seg, length, prefix))
    if not len(hit):
        return None
    ends = np.cumsum(seg["count"])
    owner = np.searchsorted(ends, hit, "right")
    start = seg["at"][owner] + hit - (ends - seg["count"])[owner]
    text = seg["text"][owner]
    order = np.lexsort((start, text))
    text, low, high = merged(text[order], start[order], length)
    cut = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
    pairs = np.stack([low, high], 1).astype("<i4")
    spans = [pairs[a:b].tobytes() for a, b in zip(cut, np.append(cut[1:], len(text)))]
    return pa.RecordBatch.from_arrays([pa.array([seg["keys"][t].tobytes() for t in text[cut]], pa.binary()), pa.array(spans, pa.binary())], schema=FOUND)


def _prefix_counts(rows: DataFrame, length: int, prefix: int) -> tuple[DataFrame, DataFrame]:
    """(runs, repeated): rows (prefix, key) of every run, and (prefix, n) of the prefixes of more than one.

    A prefix of a single run is a leaf of the tree: nothing below it repeats.
    """

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, length, prefix):
            keys = pa.array(block.keys, pa.binary()).take(pa.array(block.text))
            yield pa.RecordBatch.from_arrays([pa.array(block.key.view(np.int64)), keys], names=["prefix", "key"])

    found = materialize(rows.mapInArrow(runs, "prefix long, key binary"), "runs")
    return found, materialize(found.groupBy("prefix").agg(F.count("*").alias("n")).where("n > 1"), "prefixes")


def long_prefixes(repeated: DataFrame, most_segments: int) -> np.ndarray:
    """Sorted hashes of the prefixes that have more than most_segments segments, MOST_LONG of them at most."""
    top = repeated.where(F.col("n") > most_segments).orderBy(F.desc("n"), "prefix").limit(MOST_LONG).select("prefix").toArrow()
    return np.sort(top.column(0).to_numpy().astype(np.int64).view(np.uint64))


def repeat_spans(rows: DataFrame, texts: DataFrame, length: int = WINDOW, prefix: int = PREFIX, most_segments: int = GROUP_SEGMENTS) -> DataFrame:
    """(key, spans): lists of binary word intervals that repeats cover, by text.

    rows: (key, text, copies) of all rows, where prefixes are counted; texts: the same of different texts.
    """
    spark = texts.sparkSession
    runs, repeated = _prefix_counts(rows, length, prefix)
    long = spark.sparkContext.broadcast(long_prefixes(repeated, most_segments))
    inner = runs.join(repeated.select("prefix"), "prefix", "left_semi").groupBy("key").agg(F.collect_set("prefix").alias("inner"))
    texts = texts.join(inner, "key").select("key", "text", "copies", "inner")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = BUCKETS_EACH * partitions

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, length, prefix):
            bucket = ((block.key >> np.uint64(20)) % np.uint64(buckets)).astype(np.int32)
            run = np.argsort(bucket, kind="stable")
            run = run[np.isin(block.key[run], block.inner)]
            if len(long.value):
                run = run[~np.isin(block.key[run], long.value)]
            if not len(run):
                continue
            cut = np.flatnonzero(np.diff(bucket[run], prepend=-1))
            for a, b in zip(cut, np.append(cut[1:], len(run))):
                yield pa.RecordBatch.from_arrays([pa.array([bucket[run[a]]], pa.int32()), pa.array([pack(block, run[a:b], length)], pa.binary())], names=["bucket", "blob"])

    def subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs = None, []
        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if bucket != now and blobs:
                    if (out := _intervals(blobs, length, prefix)) is not None:
                        yield out
                    blobs = []
                now = bucket
                blobs.append(blob)
        if blobs and (out := _intervals(blobs, length, prefix)) is not None:
            yield out

    found = texts.mapInArrow(segments, "bucket int, blob binary").repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(subtrees, "key binary, spans binary")
    if len(long.value):
        found = found.unionByName(_long_spans(rows, long, length, prefix))
    return found.groupBy("key").agg(F.collect_list("spans").alias("spans"))


def _long_spans(rows: DataFrame, long, length: int, prefix: int) -> DataFrame:
    """Repeats under lengthened prefixes: a window is its own prefix, and only its number of suffixes counts.

    It takes all rows, copies too: their windows are few, and different texts would have to be shuffled for them.
    """
    import xxhash

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, length, prefix):
            run = np.flatnonzero(np.isin(block.key, long.value))
            word = block.hash_of[block.code]
            for part in np.array_split(run, max(1, len(run) // 20_000)):
                start = spread(block.low[part], block.count[part])
                text = np.repeat(block.text[part], block.count[part])
                yield pa.RecordBatch.from_arrays([
                    pa.array([xxhash.xxh3_128_digest(word[s : s + length].tobytes()) for s in start], pa.binary()),
                    pa.array([block.keys[t] for t in text], pa.binary()),
                    pa.array(start - block.first[text], pa.int32()),
                    pa.array([block.copies[t] for t in text], pa.int64()),
                ], names=["window", "key", "at", "copies"])

    rows = materialize(rows.mapInArrow(windows, "window binary, key binary, at int, copies long"), "long-prefixes")
    often = materialize(rows.groupBy("window").agg(F.sum("copies").alias("n")).where("n > 1").select("window"), "often")
    hit = rows.join(F.broadcast(often) if often.count() <= BROADCAST_WINDOWS else often, "window").groupBy("key").agg(F.sort_array(F.collect_set("at")).alias("at"))

    @F.arrow_udf("binary")
    def spans(starts: pa.Array) -> pa.Array:
        out = []
        for s in starts:
            at = s.values.to_numpy(zero_copy_only=False).astype(np.int64)
            _, low, high = merged(np.zeros(len(at), np.int64), at, length)
            out.append(np.stack([low, high], 1).astype("<i4").tobytes())
        return pa.array(out, pa.binary())

    return hit.select("key", spans("at").alias("spans"))


RESULT = "struct<kept: string, n_words: long, n_removed: long, spans: array<struct<start: int, end: int>>>"


def _cut(length: int):
    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])

    @F.arrow_udf(RESULT)
    def cut(text: pa.Array, spans: pa.Array, copies: pa.Array) -> pa.Array:
        rows = []
        for t, found, n in zip(text, spans.to_pylist(), copies.to_pylist()):
            words = (t.as_buffer().to_pybytes() if t.is_valid else b"").split()
            gone = np.zeros(len(words) + 1, np.int32)
            if n > 1 and len(words) >= length:
                gone[0], gone[-1] = 1, -1
            for pairs in found or ():
                low, high = np.frombuffer(pairs, "<i4").reshape(-1, 2).T
                np.add.at(gone, low, 1)
                np.add.at(gone, high, -1)
            mask = np.cumsum(gone) > 0
            edge = np.flatnonzero(np.diff(mask, prepend=False)).tolist()
            parts, at, joined = [], 0, []
            for a, b in zip(edge[::2], edge[1::2]):
                parts += words[at:a]
                at = b
                joined.append({"start": a, "end": b})
            parts += words[at:]
            rows.append((b" ".join(parts).decode(), len(words), len(words) - len(parts), joined))
        kept, n_words, n_removed, joined = zip(*rows) if rows else ((),) * 4
        return pa.StructArray.from_arrays([pa.array(kept, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(joined, pa.list_(span))], names=["kept", "n_words", "n_removed", "spans"])

    return cut


def text_digest(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def dedup_texts(df: DataFrame, text_col: str = "text", length: int = WINDOW, prefix: int = PREFIX, most_segments: int = GROUP_SEGMENTS) -> DataFrame:
    """One row per different text of df: key (`text_digest`), kept, n_words, n_removed and the removed spans."""
    if not 1 <= prefix <= length:
        raise ValueError("a prefix has between one word and those of a window")
    bounded_batches(df.sparkSession)
    rows = df.select(text_digest(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    texts = rows.groupBy("key").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    spans = repeat_spans(rows.select("key", "text", F.lit(1).cast("long").alias("copies")), texts, length, prefix, most_segments)
    out = texts.join(spans, "key", "left").select("key", _cut(length)("text", "spans", "copies").alias("r"))
    return out.select("key", "r.*")


def dedup_substrings(df: DataFrame, text_col: str = "text", length: int = WINDOW, kept_col: str = "kept", spans_col: str = "removed_spans", **options) -> DataFrame:
    """Add to each row the text that is left of it and the removed word intervals."""
    key = "__ketframe_key"
    done = dedup_texts(df, text_col, length, **options).select(F.col("key").alias(key), F.col("kept").alias("__ketframe_kept"), F.col("spans").alias("__ketframe_spans"))
    out = df.withColumn(key, text_digest(F.col(text_col))).join(done, key, "left")
    return out.withColumns({kept_col: F.col("__ketframe_kept"), spans_col: F.col("__ketframe_spans")}).drop(key, "__ketframe_kept", "__ketframe_spans")


def op5(spark, sf_dir: str) -> DataFrame:
    """Contract query: what is left of every document after removing repeats of 35 words."""
    docs = documents(spark, sf_dir)
    done = dedup_texts(docs).select("key", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
    return docs.select("doc_id", text_digest(F.col("text")).alias("key")).join(done, "key").select("doc_id", "n_words", "n_removed", "kept_sha256")


OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT r, w, unnest(generate_series(1, len(w) - 34)) AS a FROM d WHERE len(w) >= 35),
k AS (SELECT r, a, md5(array_to_string(list_slice(w, a, a + 34), ' ')) AS h FROM p),
often AS (SELECT h FROM k GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(generate_series(a, a + 34)) AS i FROM k JOIN often USING (h)),
words AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY i) AS t, count(*) AS n FROM words ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""
