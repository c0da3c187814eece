import random

import numpy as np
import pytest
import xxhash

from ketframe.llm import pipeline
from ketframe.llm import simhash as op
from ketframe.llm.components import components


def slow_fingerprint(text, k):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or "")).replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    parts = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def slow_components(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def cluster(rng, size):
    """Fingerprints around a few centres, so that buckets are crowded."""
    centres = [rng.getrandbits(64) for _ in range(3)]
    return [rng.choice(centres) ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) for _ in range(size)] + [0]


@pytest.mark.parametrize("segments, hot", [(2, 2_000), (2, 3), (4, 2_000), (4, 3)])
def test_links_are_complete(spark, segments, hot):
    fps = sorted({x & (2**64 - 1) for x in cluster(random.Random(7), 250)})
    got = {(r.a, r.b) for r in op.hamming_links(spark.createDataFrame([(signed(x),) for x in fps + fps[:5]] + [(None,)], "fp long"), 3, segments, hot).collect()}
    want = {tuple(sorted((signed(a), signed(b)))) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3}
    assert got == want and want


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(150)] + [(5, 5), (7, 6)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links + [(None, 3)], "a long, b long"), "a", "b").collect()}
    nodes = {x for a, b in links for x in (a, b) if a != b}
    assert got == slow_components(links, nodes)
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_edges(spark):
    text = "One two three four five six seven eight nine ten"
    rows = [(3, text), (2, text.lower()), (None, text.upper()), (9, None), (8, ""), (8, ""), (7, " \t\n"), (1, "one"), (0, "ONE"), (5, "word " * 30_000), (None, "unlike all")]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, fp string, key string")
    got = op.near_duplicates(df).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add((r.fp, r.component_id))
    assert by[3] == by[2] == {(signed(slow_fingerprint(text, 3)), 2)}
    assert by[9] == by[8] == by[7] == {(0, 7)}
    assert by[1] == by[0] and {c for _, c in by[0]} == {0}
    assert (signed(slow_fingerprint(text, 3)), 2) in by[None] and (signed(slow_fingerprint("unlike all", 3)), None) in by[None]
    kept = sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in op.keep_one_of_each(df, op.near_duplicates(df)).collect())
    assert kept == sorted([(2, text.lower()), (7, " \t\n"), (0, "ONE"), (5, "word " * 30_000), (-1, "unlike all")])
    assert op.near_duplicates(df.limit(0)).count() == 0


def test_query_against_brute_force(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    fps = {i: slow_fingerprint(t, 3) for i, t in docs.items()}
    ids = sorted(docs)
    root = slow_components([(a, b) for a in ids for b in ids if a < b and (fps[a] ^ fps[b]).bit_count() <= 3], ids)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op.op3(spark, sf).collect()}
    assert got == {i: (f"{fps[i]:016x}", root[i]) for i in ids}


def slow_similar(docs, shingle=5, similarity=0.8):
    """Root id by id: all pairs by the Jaccard similarity of their sets of shingles; texts without words are alike."""
    sets = {}
    for i, text in docs.items():
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({c: " " for c in range(9, 14)}).split(" ")
        w = [x for x in w if x]
        sets[i] = frozenset(tuple(w[k : k + shingle]) for k in range(max(len(w) - shingle + 1, 1))) if w else frozenset()
    ids = sorted(docs)
    pairs = []
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if min(len(x), len(y)) >= similarity * max(len(x), len(y)) - 1e-9:
                both = len(x & y)
                if x == y or both >= similarity * (len(x) + len(y) - both) - 1e-9:
                    pairs.append((a, b))
    return slow_components(pairs, ids)


def mutated(rng, words, share):
    return " ".join(w if rng.random() > share else f"new{rng.randrange(10**6)}" for w in words)


def test_similar_documents(spark):
    rng = random.Random(8)
    texts = []
    for g in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 300))]
        texts += [mutated(rng, words, share) for share in [0.0, 0.0, *[rng.choice([0.004, 0.01, 0.02, 0.05, 0.3]) for _ in range(25 if g == 0 else 4)]]]
    texts += [None, "", " ", "a b", "A  b", "lone"]
    docs = dict(enumerate(texts))
    df = spark.createDataFrame([(i, t, 0) for i, t in docs.items()], "doc_id long, text string, s0 int").repartition(3)
    got = op.similar_documents(df).collect()
    by, want = {}, {}
    for r in got:
        by.setdefault(r.root, set()).add(r.doc_id)
    for i, root in slow_similar(docs).items():
        want.setdefault(root, set()).add(i)
    assert sorted(map(sorted, by.values())) == sorted(map(sorted, want.values()))

    def jaccard(x, y):
        a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (x.split(), y.split()))
        return len(a & b) / len(a | b)

    root = {i: r for r, ids in by.items() for i in ids}
    assert len(by) < len(docs) - 20
    for g in range(12):  # well above the threshold together, well below it apart
        first = 0 if g == 0 else 27 + 6 * (g - 1)
        for i in range(first, first + (27 if g == 0 else 6)):
            if jaccard(docs[first], docs[i]) > 0.92:
                assert root[i] == root[first]
    assert root[len(texts) - 6] == root[len(texts) - 5] == root[len(texts) - 4] and root[len(texts) - 3] == root[len(texts) - 2]
    kept = op.keep_one_of_each(df, op.similar_documents(df))
    assert {r.doc_id for r in kept.collect()} == {min(ids) for ids in by.values()} and kept.columns == df.columns
    assert op.similar_documents(df.limit(0)).count() == 0


def test_crowded_values_lose_no_pair(spark):
    """Classes that share one key, in clusters whose first holder is near none of them."""
    rng = random.Random(9)
    rows = []
    for c in range(6):
        centre = [rng.getrandbits(64) for _ in range(op.WIDE_LONGS)]
        for _ in range(8):
            s = list(centre)
            s[rng.randrange(op.WIDE_LONGS)] ^= 1 << rng.randrange(64)
            rows.append((rng.getrandbits(63), *map(signed, s), 100, c))
    df = spark.createDataFrame(rows, "node long, " + "".join(f"{n} long, " for n in op.WIDE_NAMES) + "size int, c int")
    root = {r.node: r.root for r in op.similar_links(df.drop("c"), df.selectExpr("node", "1L AS key")).collect()}
    for c in range(6):
        nodes = [r[0] for r in rows if r[-1] == c]
        assert {root[n] for n in nodes} == {min(nodes)}


def test_added_and_cut_passages_against_brute_force(spark, monkeypatch):
    """Pairs by exact Jaccard: a passage appended, put in, or cut out; and words replaced."""
    rng = random.Random(10)
    zipf = [1 / (i + 1) for i in range(20_000)]
    draw = lambda n: [f"w{x}" for x in rng.choices(range(20_000), zipf, k=n)]
    texts = []
    for g in range(160):
        base = draw(rng.randrange(80, 500))
        n, at = len(base) // rng.randrange(7, 14), rng.randrange(10, len(base) // 2)
        other = [base + draw(n), base[:at] + draw(n) + base[at:], base[:at] + base[at + n :], mutated(rng, base, 0.015).split()][g % 4]
        texts += [" ".join(base), " ".join(other)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    called = []
    monkeypatch.setattr(op, "similar_documents", lambda *a, f=op.similar_documents, **k: called.append(f(*a, **k)) or called[0])
    pipeline.near_duplicates(spark, df, "")  # the stage as the pipeline asks for it
    root = {r.doc_id: r.root for r in called[0].collect()}
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    similar = lambda a, b: 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])
    pairs = [(a, b) for a in range(len(sets)) for b in range(a) if similar(a, b)]
    assert len(pairs) > 100
    lost = [(a, b) for a, b in pairs if root[a] != root[b]]
    assert len(lost) <= 0.02 * len(pairs), f"{len(lost)} of {len(pairs)} lost"
    assert not [(a, b) for a in range(len(sets)) for b in range(a) if root[a] == root[b] and not similar(a, b)]


@pytest.mark.parametrize("table_rows", [10**6, 100])
def test_shared_segments_are_all_agreements(spark, monkeypatch, table_rows):
    """multi-index hashing of the wide fingerprints. A hot value keeps all its classes; shares of the values change nothing."""
    monkeypatch.setattr(op, "TABLE_ROWS", table_rows)
    rng = random.Random(11)
    centres = [[rng.getrandbits(64) for _ in range(op.WIDE_LONGS)] for _ in range(4)]
    rows = []
    for i in range(400):
        s = list(centres[i % 4]) if i < 200 else [rng.getrandbits(64) for _ in range(op.WIDE_LONGS)]
        for _ in range(rng.choice([1, 20, 40, 150])):
            s[rng.randrange(op.WIDE_LONGS)] ^= 1 << rng.randrange(64)
        rows.append((i, 0 if i == 399 else rng.choice([5, 24, 30, 31, 400]), *map(signed, s)))
    df = spark.createDataFrame(rows, "node long, size int, " + ", ".join(f"{n} long" for n in op.WIDE_NAMES)).repartition(3)
    classes = op.materialize(df.withColumn("no", op.F.monotonically_increasing_id()), "classes")
    found = op.shared_segments(classes, 0.8).collect()
    got = {}
    for r in found:
        got.setdefault(r.key, set()).add(r.node)
    assert len(found) == sum(map(len, got.values()))

    plan = op.segment_plan(400, 0.8)
    bit = {i: np.unpackbits(np.array(s, np.int64).view(np.uint8), bitorder="little") for i, _, *s in rows}
    want = []
    for n, segments in enumerate(plan):
        assert len(set(segments.ravel().tolist())) == segments.size
        for segment in segments:
            by = {}
            for i, size, *_ in rows:
                if size and (n < len(plan) // 2 or size <= 30):
                    by.setdefault(bit[i][segment].tobytes(), set()).add(i)
            want += [sorted(nodes) for nodes in by.values() if len(nodes) > 1]
    assert sorted(map(sorted, got.values())) == sorted(want) and max(map(len, want)) > 20

    met = {(a, b) for nodes in want for a in nodes for b in nodes if a < b}
    surely = [(a, b) for a, b in ((a, b) for b in range(399) for a in range(b)) if (bit[a] ^ bit[b]).sum() < plan.shape[1]]
    assert len(surely) > 100 and met.issuperset(surely)  # fewer bits than a permutation has segments


@pytest.mark.parametrize("classes", [300, 41_000, 12_000_000])
@pytest.mark.parametrize("size", [5, 10, 24, 40, 300])
def test_segments_find_pairs_at_the_threshold(classes, size):
    """recall at a Jaccard similarity of 0.8, a passage appended or words replaced, by segments of the width that so many classes have."""
    rng = np.random.default_rng(size)
    plan = op.segment_plan(classes, 0.8)
    plan = plan if size <= op.SMALL_SET else plan[: len(plan) // 2]
    lost = 0
    for k in range(300):
        items = rng.integers(0, 2**64, 2 * size, dtype=np.uint64)
        both = -(-8 * size // (10 if k % 2 else 9))
        a, b = items[:size], items[:both] if k % 2 else np.concatenate([items[:both], items[size : 2 * size - both]])
        assert both >= 0.8 * (len(a) + len(b) - both)
        differ = np.unpackbits((op._set_bits(a, op.WIDE_LONGS) ^ op._set_bits(b, op.WIDE_LONGS)).view(np.uint8), bitorder="little")
        lost += differ[plan].any(2).all()
    assert lost <= (6 if size == 5 else 3)


def test_near_dedup_takes_its_candidates_from_segments(spark, monkeypatch):
    """without what agrees in a segment of the fingerprints, the stage finds no pair."""
    words = [f"w{i}" for i in range(120)]
    df = spark.createDataFrame([(0, " ".join(words)), (1, " ".join([*words, "more"])), (2, "other " * 60), (3, " ".join(words[1:]))], "doc_id long, text string")
    assert sorted(r.doc_id for r in pipeline.near_duplicates(spark, df, "").collect()) == [0, 2]
    monkeypatch.setattr(op, "shared_segments", lambda classes, similarity, f=op.shared_segments: f(classes, similarity).limit(0))
    assert pipeline.near_duplicates(spark, df, "").count() == 4
