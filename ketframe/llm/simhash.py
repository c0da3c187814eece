"""SimHash near-duplicates by multi-index hashing.

Fingerprints of 64 bits are reduced to distinct ones first, so exact copies
cost one row however many there are. Two fingerprints that differ in at most d
bits differ in at most d // m bits in one of m segments. Each fingerprint is
filed once under each of its segments, and asks for every value in the small
Hamming ball (radius d // m) around each of them; what the join returns is
verified by the complete distance. A segment value under which more than
HOT_BUCKET distinct fingerprints are filed is filed again under one more
segment of the rest of the bits, with the same guarantee, so a crowded bucket
never meets itself as a whole. No bucket, partner or candidate is capped.

Links then go to `components`. Nothing but counts reaches the driver.

`similar_documents` is for a threshold of similarity at which fingerprints differ in so many bits that the Hamming
balls of a few segments would return the square of the corpus. Its fingerprints have WIDE_BITS bits, over the sets of
shingles, and are cut into segments under several permutations of the bits. Each is filed under the value of every
segment; two that agree in one are a candidate. Fingerprints that differ in fewer bits than a permutation has segments
agree in one of them; at the threshold it takes the segments of all permutations (see `segment_plan`). Segments widen
with the corpus, so that what agrees by chance stays a small share of what is filed. Candidates are verified by the
complete distance in bits and by the sizes of the sets, and then the sets of shingles
themselves are compared, so no pair below the threshold is linked.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ketframe.llm._common import BROADCAST_KEYS, bounded_batches, documents, materialize, release, row_key, without_keys
from ketframe.llm.components import components

BITS = 64
SEED = 42
#: Fingerprints under one segment value beyond which a second segment is added.
HOT_BUCKET = 2_000


def fingerprint(text: str | None, shingle: int, seed: int = SEED) -> int:
    """Signed 64-bit fingerprint of one text; of no words, zero."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in parts), np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65_536):
        ones += np.unpackbits(hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def simhash(df: DataFrame, text_col: str = "text", out_col: str = "simhash", shingle: int = 3) -> DataFrame:
    """Add the fingerprint of each text as a signed long.

    Words are runs of other than ASCII white space, A-Z in lower case. A text of
    fewer words than a shingle is one shingle; null or no words give zero.
    """
    bounded_batches(df.sparkSession)

    @F.arrow_udf("long")
    def fingerprints(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(t.as_py(), shingle) for t in texts], pa.int64())

    return df.withColumn(out_col, fingerprints(F.col(text_col)))


def _ball(width: int, radius: int) -> list[int]:
    """Every mask of `width` bits with at most `radius` of them set."""
    return [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]


def _segments(low: int, high: int, count: int) -> list[tuple[int, int]]:
    """(first bit, width) of `count` segments that share out the bits from low to high."""
    cuts = [low + (high - low) * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _value(fp: Column, first: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << width) - 1))


def _keys(fp: Column, segments: list[tuple[int, int]], radius: int) -> Column:
    """array<struct<seg, key>> of the values to file under (radius 0) or to ask for."""

    def ball(s: int, first: int, width: int) -> Column:
        masks = F.array(*(F.lit(mask) for mask in _ball(width, radius)))
        return F.transform(masks, lambda mask: F.struct(F.lit(s).alias("seg"), _value(fp, first, width).bitwiseXOR(mask).alias("key")))

    return F.flatten(F.array(*(ball(s, *segment) for s, segment in enumerate(segments))))


def _filed(rows: DataFrame, name: str, segments: list[tuple[int, int]], radius: int) -> DataFrame:
    return rows.select(F.col("fp").alias(name), F.explode(_keys(F.col("fp"), segments, radius)).alias("k")).select(name, "k.seg", "k.key")


def hamming_links(fps: DataFrame, max_bits: int = 3, segments: int = 2, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """(a, b), a < b: all pairs of distinct fingerprints (column fp) that differ in at most max_bits bits."""
    fps = fps.select("fp").where("fp is not null").distinct()
    if segments < 2:
        raise ValueError("at least two segments are needed")
    cut = _segments(0, BITS, segments)
    radius = max_bits // segments
    asked, filed = _filed(fps, "a", cut, radius), _filed(fps, "b", cut, 0)
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
    hot = materialize(filed.groupBy("seg", "key").count().where(F.col("count") > hot_bucket).select("seg", "key"), "hot-segments")
    if hot.isEmpty():
        return asked.join(filed, ["seg", "key"]).where(near).select("a", "b").distinct()

    # A crowded value: the pair differs in at most max_bits of the other bits too, so in
    # at most max_bits // parts of them in one of their parts.
    parts = max_bits // 2 + 1
    links = asked.join(hot, ["seg", "key"], "left_anti").join(filed.join(hot, ["seg", "key"], "left_anti"), ["seg", "key"]).where(near).select("a", "b")
    for s, (first, width) in enumerate(cut):
        rest = [x for low, high in ((0, first), (first + width, BITS)) if high > low for x in _segments(low, high, parts)]

        def again(rows: DataFrame, name: str, r: int, s=s, rest=rest) -> DataFrame:
            crowded = rows.where(F.col("seg") == s).join(hot.where(F.col("seg") == s), ["seg", "key"], "left_semi")
            return crowded.select(name, "key", F.explode(_keys(F.col(name), rest, r)).alias("k")).select(name, "key", F.col("k.seg").alias("seg2"), F.col("k.key").alias("key2"))

        found = again(asked, "a", max_bits // parts).join(again(filed, "b", 0), ["key", "seg2", "key2"])
        links = links.unionByName(found.where(near).select("a", "b"))
    return links.distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """One row per row of df: key (see `row_key`), doc_id, fp, root, component_id and links.

    component_id is the smallest id that links reach, the row's own included; links counts the
    other distinct fingerprints that the row's fingerprint links to. Null ids come last: a
    component's id is null only where no member has one. Repeated rows are rows of one fingerprint.
    """
    rows = df.select(row_key(F.col(id_col), F.col(text_col)).alias("key"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = materialize(simhash(rows, "text", "fp", shingle).drop("text"), "fingerprints", packed=True)
    links = materialize(hamming_links(rows, max_bits), "hamming-links")
    roots = components(links, "a", "b")
    degree = links.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count("*").alias("links"))
    classes = rows.groupBy("fp").agg(F.min("doc_id").alias("least")).join(roots.withColumnRenamed("node", "fp"), "fp", "left").join(degree, "fp", "left")
    classes = classes.select("fp", "least", F.coalesce("root", "fp").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    ids = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(classes.join(ids, "root").select("fp", "root", "component_id", "links"), "fp")


# Similar documents ---------------------------------------------------------------------------

#: Longs of the comparison fingerprint, and its bits.
WIDE_LONGS = 32
#: Longs of it that pairs are sifted by first, so that what agrees by chance never meets the rest, and their deviations.
FIRST_LONGS, FIRST_MARGIN = 4, 4.0
WIDE_BITS = BITS * WIDE_LONGS
SIMILARITY = 0.8
#: Standard deviations of the distance that are allowed for before sets are compared: 0.999 of pairs at the threshold are.
MARGIN = 3.0
#: Sets of fewer shingles are compared whatever their fingerprints, whose bits are too dependent; they are filed under twice as many segments.
SMALL_SET = 24
#: Chance that a pair at the threshold agrees in no segment, for independent bits; segments share bits, so it is more: see README.
SEGMENT_MISS = 1e-4
#: Bits of a segment beyond those that number the classes: at most one class in 2 ** SPARE_BITS agrees with another by chance.
SPARE_BITS = 5
LEAST_SEGMENT = 16
#: Classes whose values of one segment one task looks through; of more, each task takes a share of the values.
TABLE_ROWS = 16_000_000
WIDE_NAMES = [f"s{k}" for k in range(WIDE_LONGS)]


def _share(similarity: float) -> float:
    """Share of bits that differ: sets of equal size with Jaccard J have cosine 2J / (1 + J), and a bit differs with angle / pi."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def most_bits(similarity: float, bits: int = WIDE_BITS, margin: float = MARGIN) -> int:
    """Differing bits of so many up to which two sets may have this Jaccard similarity: margin standard deviations above the mean."""
    share = _share(similarity)
    return int(bits * share + margin * np.sqrt(bits * share * (1 - share)))


def _hashes(items: set[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in items), np.uint64, len(items))


def _set_bits(hashes: np.ndarray, longs: int) -> np.ndarray:
    """SimHash of a set: `longs` signed words, each from another mix of the items' hashes."""
    factors = np.arange(1, 2 * longs, 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    ones = np.zeros(BITS * longs, np.int64)
    for at in range(0, len(hashes), 255):  # as many as a byte can count
        x = hashes[at : at + 255, None] * factors
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        ones += np.add.reduce(np.unpackbits(x.view(np.uint8), axis=1, bitorder="little"), 0, np.uint8)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)


def segment_plan(classes: int, similarity: float) -> np.ndarray:
    """The bits of segments: permutations, segments of one (they share no bit), bits. The second half of the permutations is for small sets.

    A segment of w bits agrees with probability (1 - share) ** w at the threshold. There are as many segments as leave
    SEGMENT_MISS, in whole permutations, and as many again.
    """
    width = max(LEAST_SEGMENT, classes.bit_length() + SPARE_BITS)
    each = WIDE_BITS // width
    needed = np.log(SEGMENT_MISS) / np.log1p(-((1 - _share(similarity)) ** width))
    rng = np.random.default_rng(SEED)
    return np.stack([rng.permutation(WIDE_BITS)[: each * width].reshape(each, width) for _ in range(2 * int(np.ceil(needed / each)))]).astype(np.int16)


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Sorted hashes of a text's different shingles; a text of fewer words has one, a text without words none."""
    words = (text or "").encode().lower().split()
    parts = set(map(b" ".join, zip(*(words[i:] for i in range(shingle))))) if len(words) >= shingle else {b" ".join(words)} if words else set()
    return np.sort(_hashes(parts))


def _wide_fingerprint(text: str | None, shingle: int) -> tuple[int, int, np.ndarray]:
    """Digest and size of the set of shingles, and its fingerprint of WIDE_LONGS; of no words, zeros."""
    import xxhash

    parts = shingle_set(text, shingle)
    node = int(np.uint64(xxhash.xxh3_64_intdigest(parts.tobytes())).view(np.int64))
    return node, len(parts), _set_bits(parts, WIDE_LONGS)


def _blocks(batches: Iterator[pa.RecordBatch], plan: np.ndarray, most: float, shares: int) -> Iterator[pa.RecordBatch]:
    """Values of the batches' fingerprints, packed by segment and share of the values; sets of up to `most` shingles are filed under all permutations.

    A block has the number of its first row, and at (16 bits each) where the others are after it, empty if they follow one another.
    """
    permutations, each, width = plan.shape
    for batch in batches:
        no, sizes = batch.column("no").to_numpy(), batch.column("size").to_numpy()
        longs = np.stack([batch.column(n).to_numpy() for n in WIDE_NAMES], 1)
        order = np.argsort(no)  # parts of a file may come in any order
        no, sizes, longs = no[order], sizes[order], longs[order]
        out = []
        for page in np.unique(no >> 16):
            for n, segments in enumerate(plan):
                here = np.flatnonzero((no >> 16 == page) & (sizes > 0) & ((n < permutations // 2) | (sizes <= most)))
                if not len(here):
                    continue
                bits = np.unpackbits(longs[here].view(np.uint8), axis=1, bitorder="little")
                values = np.packbits(bits[:, segments], axis=2, bitorder="little")
                first, at = int(no[here[0]]), no[here] - no[here[0]]
                packed = b"" if shares == 1 and at[-1] == len(at) - 1 else at.astype(np.uint16)
                for s in range(each):
                    if shares == 1:
                        out.append((n * each + s, 0, first, bytes(packed), values[:, s].tobytes()))
                        continue
                    share = values[:, s, 0] % shares
                    out += [(n * each + s, int(k), first, packed[share == k].tobytes(), values[share == k, s].tobytes()) for k in np.unique(share)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["segment", "share", "first", "at", "packed"])


def _agreeing(segment: int, blocks: pa.Table, width: int) -> pa.Table:
    """Numbers and keys of the rows of a segment's blocks whose value another row has."""
    size = -(-width // 8)
    wide = np.zeros((sum(len(b.as_py()) for b in blocks["packed"]) // size, 8), np.uint8)
    wide[:, :size] = np.frombuffer(b"".join(b.as_py() for b in blocks["packed"]), np.uint8).reshape(-1, size)
    values, numbers = wide.view("<u8").ravel().astype(np.int64), []
    for first, at, packed in zip(*(blocks[c].to_pylist() for c in ("first", "at", "packed"))):
        numbers.append(first + (np.frombuffer(at, np.uint16).astype(np.int64) if at else np.arange(len(packed) // size)))
    order = np.argsort(values, kind="stable")
    values = values[order]
    met = np.zeros(len(values) + 1, bool)
    met[1:-1] = values[1:] == values[:-1]
    met = met[1:] | met[:-1]
    return pa.table({"no": np.concatenate(numbers)[order][met], "key": values[met] | segment << width})


def shared_segments(classes: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(node, key) of the classes that agree with another one in a segment of their fingerprints; key tells segment and value.

    classes: node, no (from monotonically_increasing_id, so that rows of a block need no ids), size and WIDE_NAMES.
    Sets without shingles are not filed. No value is left out, however many classes have it.
    """
    count = classes.count()
    plan, shares = segment_plan(count, similarity), min(256, 1 + count // TABLE_ROWS)
    width = plan.shape[2]
    filed = classes.select("no", "size", *WIDE_NAMES).mapInArrow(lambda batches: _blocks(batches, plan, SMALL_SET / similarity, shares), "segment int, share int, first long, at binary, packed binary")
    met = filed.groupBy("segment", "share").applyInArrow(lambda key, blocks: _agreeing(key[0].as_py(), blocks, width), "no long, key long")
    return met.join(classes.select("no", "node"), "no").select("node", "key")


def similar_links(classes: DataFrame, filed: DataFrame, similarity: float = SIMILARITY, verify=lambda pairs: pairs) -> DataFrame:
    """(node, root) of all classes that links reach from another; classes: node, size and WIDE_NAMES; filed: node and key.

    verify keeps those of some pairs (a, b) of nodes that are similar in fact.

    A key that very many classes share must not meet itself pair by pair. So first every class is compared with one
    holder of each of its keys only, and components are formed. The holder is the class whose own keys have most holders
    in all: in a family of near copies the one that they are copies of, which is near to all of them where they are not near to each
    other. Then the classes of a key meet in full only across
    components, those of lower ones with those of higher ones. That loses no pair: pairs that are left out are in
    one component already, or the two of a key that no third class has, of which one is the holder.
    """

    def side(x: str, longs: int = WIDE_LONGS) -> DataFrame:
        whole = lambda c: F.coalesce(F.col(c), F.lit(0))  # noqa: E731 - no nulls: without code for them the join's method stays short enough to be compiled
        return classes.select(F.col("node").alias(x), whole("size").alias(f"{x}_size"), *(whole(f"s{k}").alias(f"{x}{k}") for k in range(longs)))

    def near(longs: int = WIDE_LONGS, margin: float = MARGIN) -> Column:
        less, more_of = F.least("a_size", "b_size"), F.greatest("a_size", "b_size")
        bits = sum(F.bit_count(F.col(f"a{k}").bitwiseXOR(F.col(f"b{k}"))) for k in range(longs))
        return (less >= similarity * more_of - 1e-6) & ((less < SMALL_SET) | (bits <= most_bits(similarity, BITS * longs, margin)))

    shared = filed.join(filed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key")
    shared = materialize(shared, "shared-keys")
    known = shared.groupBy("node").agg(F.sum("n").alias("known"))
    holder = shared.join(known, "node").groupBy("key").agg(F.max(F.struct("known", "node"))["node"].alias("holder"))
    first = shared.join(holder, "key").where("node <> holder").select(F.col("node").alias("a"), F.col("holder").alias("b"))
    first = first.distinct().join(side("a", FIRST_LONGS), "a").join(side("b", FIRST_LONGS), "b").where(near(FIRST_LONGS, FIRST_MARGIN)).select("a", "b")
    pairs = materialize(first.join(side("a"), "a").join(side("b"), "b").where(near()).select("a", "b"), "first-links")
    links = verify(pairs)
    roots = materialize(components(links, "a", "b"), "roots")

    held = shared.where("n > 2").join(roots, "node", "left").select("node", "key", F.coalesce("root", "node").alias("root"))
    spread = held.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    held = materialize(held.join(spread, "key").select("node", "key", "root", "high"), "across")  # keys of one component are done with
    asking = held.where("root < high").select(F.col("node").alias("a"), F.col("root").alias("a_root"), "key").join(side("a"), "a")
    holding = held.select(F.col("node").alias("b"), F.col("root").alias("b_root"), "key").join(side("b"), "b")
    across = asking.join(holding, "key").where((F.col("a_root") < F.col("b_root")) & near())  # all of it within the join
    pairs = materialize(across.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "more-links")
    more = verify(pairs)
    done = [shared, held, pairs]
    if not more.isEmpty():
        again = materialize(components(links.unionByName(more), "a", "b"), "roots")
        done, roots = [*done, roots], again
    release(*done)
    return roots


def similar_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of df: key (see `row_key`), doc_id, node and root.

    Texts with the same set of shingles are one class, named by a digest of it (node); root names its
    component: classes that links of at least this Jaccard similarity reach. Texts without words are
    linked to each other.
    """
    bounded_batches(df.sparkSession)
    fields = "node: long, size: int, " + ", ".join(f"{n}: long" for n in WIDE_NAMES)

    @F.arrow_udf(f"struct<{fields}>")
    def wide(texts: pa.Array) -> pa.Array:
        made = [_wide_fingerprint(t.as_py(), shingle) for t in texts]
        longs = np.array([f for *_, f in made], np.int64).reshape(-1, WIDE_LONGS)
        node, size = pa.array([n for n, *_ in made], pa.int64()), pa.array([n for _, n, _ in made], pa.int32())
        return pa.StructArray.from_arrays([node, size, *(pa.array(c) for c in longs.T.copy())], names=["node", "size", *WIDE_NAMES])

    key, text = row_key(F.col(id_col), F.col(text_col)).alias("key"), F.col(text_col).alias("text")
    rows = df.select(key, F.col(id_col).alias("doc_id"), wide(F.col(text_col)).alias("w"))
    rows = materialize(rows.select("key", "doc_id", "w.*"), "wide-fingerprints", packed=True)
    classes = rows.select("node", "size", *WIDE_NAMES).dropDuplicates(["node"]).withColumn("no", F.monotonically_increasing_id())
    classes = materialize(classes, "classes")
    filed = materialize(shared_segments(classes, similarity), "segments")

    def verify(pairs: DataFrame) -> DataFrame:
        return jaccard_links(pairs, rows, df.select(key, text), shingle, similarity)

    roots = similar_links(classes, filed, similarity, verify)
    release(classes, filed)
    return rows.select("key", "doc_id", "node").join(roots, "node", "left").select("key", "doc_id", "node", F.coalesce("root", "node").alias("root"))


def jaccard_links(pairs: DataFrame, rows: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose sets of shingles have this Jaccard similarity.

    rows: key and node of all texts; texts: key and text. Only texts of nodes in pairs are cut into shingles, one a node.
    """
    share = Fraction(similarity).limit_denominator(10_000)

    @F.arrow_udf("array<long>")
    def sets(texts: pa.Array) -> pa.Array:
        return pa.array([shingle_set(t.as_py(), shingle).view(np.int64) for t in texts], pa.list_(pa.int64()))

    @F.arrow_udf("boolean")
    def similar(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(a, b):
            x, y = x.values.to_numpy(), y.values.to_numpy()
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(both * share.denominator >= (len(x) + len(y) - both) * share.numerator)
        return pa.array(out, pa.bool_())

    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    asked = materialize(rows.join(asked, "node").groupBy("node").agg(F.min("key").alias("key")), "compared", packed=True)
    if asked.isEmpty():
        return pairs
    few = asked.count() <= BROADCAST_KEYS
    found = texts.join(F.broadcast(asked) if few else asked, "key").select("node", sets("text").alias("hashes"))
    found = materialize(found.groupBy("node").agg(F.first("hashes").alias("hashes")), "shingle-sets")
    both = pairs.join(found.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a").join(found.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
    out = materialize(both.where(similar("x", "y")).select("a", "b"), "similar", packed=True)
    release(found)
    return out


def keep_one_of_each(df: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df without all but one row of each component of `found`; columns as in df.

    found is what near_duplicates or similar_documents made of df. The row with the component's
    smallest id stays, of several the one with the smallest key, of rows that agree in id and text one.
    """
    key = "__ketframe_key"
    found = materialize(found, "components")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")
    best = found.groupBy("root").agg(F.min(order).alias("best")).select(F.col("best.key").alias(key))
    counts = found.groupBy(F.col("key").alias(key)).agg(F.count("*").alias("n"))
    others = materialize(counts.join(best, key, "left_anti").select(key), "other-keys")
    twice = materialize(counts.where("n > 1").join(best, key, "left_semi").select(key), "repeated-keys")
    rows = without_keys(df.withColumn(key, row_key(F.col(id_col), F.col(text_col))), key, others)
    if not twice.isEmpty():
        again = rows.join(twice, key, "left_semi").dropDuplicates([key])
        rows = without_keys(rows, key, twice).unionByName(again)
    return rows.drop(key)


def op3(spark, sf_dir: str) -> DataFrame:
    """Contract query: fingerprint and component of every document."""
    found = near_duplicates(documents(spark, sf_dir), shingle=3, max_bits=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", F.col("links").cast("long").alias("n_links"))
