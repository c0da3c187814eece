import random
import re

import pytest

from ketframe.llm import decontaminate as op

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def cut(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, size):
    windows = {}
    for item, text in items:
        w = cut(text)
        for i in range(max(1, len(w) - size + 1)) if w else ():
            windows.setdefault(tuple(w[i : i + size]), set()).add(item)
    out = []
    for _, text in docs:
        w, hit, found = cut(text), set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if (x := tuple(w[i : i + k])) in windows:
                    hit.update(range(i, i + k))
                    found |= {str(n) for n in windows[x] if n is not None}
        out.append((len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("size, shingle, block", [(13, 3, 100_000), (4, 2, 100_000), (4, 3, 5), (13, 3, 5), (2, 3, 5)])
def test_against_brute_force(spark, monkeypatch, size, shingle, block):
    monkeypatch.setattr(op, "BROADCAST_WINDOWS", block)
    monkeypatch.setattr(op, "BROADCAST_TOKENS", block)
    rng = random.Random(size)
    vocabulary = ["the", "The", "of", "Élan", "élan", "x1", "日本", "w-y", "a_b", "zz", "it's"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "\x00"]) for _ in range(n))
    items = [(i % 9, text(rng.randrange(1, 3 * size))) for i in range(12)] + [(90, ""), (91, None), (None, text(size)), (92, "zz x1"), (93, "  Zz, x1!")]
    docs = [(i, text(rng.randrange(60)) + (rng.choice(items)[1] or "") + text(rng.randrange(60))) for i in range(60)]
    docs += [(60, None), (61, ""), (62, "..."), (None, "zz"), (5, docs[5][1]), (63, items[0][1]), (64, items[1][1] * 2000)]
    a = spark.createDataFrame(docs, "doc_id int, text string").withColumn("key", op.F.lit("k")).withColumn("w", op.F.lit(1)).repartition(3)
    b = spark.createDataFrame(items, "item_id int, text string")
    found = {bytes(r.key): r for r in op.contamination(a, b, window=size, shingle=shingle).collect()}
    keyed = a.select("text", op.text_digest(op.F.col("text")).alias("k")).collect()
    want = dict(zip((t for _, t in docs), brute(docs, items, size)))
    for r in keyed:
        x = found[bytes(r.k)]
        assert (x.n_words, x.n_hit, x["items"], x.contaminated) == want[r.text], r.text
    kept = op.drop_contaminated(a, b, window=size, shingle=shingle)
    assert kept.columns == a.columns
    assert sorted(r.text or "" for r in kept.collect()) == sorted(t or "" for _, t in docs if not want[t][3])


def test_empty_tables(spark):
    a, b = spark.createDataFrame([], "doc_id int, text string"), spark.createDataFrame([], "item_id int, text string")
    assert op.contamination(a, b).count() == 0
    some = spark.createDataFrame([(1, "x y")], "doc_id int, text string")
    assert op.contamination(a, some.withColumnRenamed("doc_id", "item_id")).count() == 0
    assert [tuple(r) for r in op.contamination(some, b).select("n_words", "n_hit", "items", "contaminated").collect()] == [(2, 0, [], False)]


def test_filter(spark):
    """All shingles pass; few others do, in one row or in several."""
    keys = spark.range(3_000).select(op.F.xxhash64("id").alias("shingle"))
    others = spark.range(10_000, 30_000).select(op.F.xxhash64("id").alias("shingle"))
    for rows in (1, 2):
        op_rows = op.FILTER_BUCKETS
        try:
            op.FILTER_BUCKETS = rows
            assert op._passing(keys, keys, 3_000, op.F.lit(False)).count() == 3_000
            assert op._passing(others, keys, 3_000, op.F.lit(False)).count() < 1_200 / rows
        finally:
            op.FILTER_BUCKETS = op_rows


def test_query_by_the_filter(spark, sf, monkeypatch):
    """The same rows where nothing but the filter is broadcast."""
    want = {r.doc_id: r for r in op.op8(spark, sf).collect()}
    monkeypatch.setattr(op, "BROADCAST_WINDOWS", 0)
    monkeypatch.setattr(op, "BROADCAST_TOKENS", 0)
    assert {r.doc_id: r for r in op.op8(spark, sf).collect()} == want and any(r.n_hit for r in want.values())


def test_query_against_sql(spark, sf):
    from tests.llm.duck import same_rows

    same_rows(op.op8(spark, sf), op.OP8_SQL, sf)
