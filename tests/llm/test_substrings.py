import hashlib
import random
from collections import Counter

import pytest

from ketframe.llm import substrings as op


def brute(texts, length):
    docs = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(d[i : i + length]) for d in docs for i in range(len(d) - length + 1))
    out = []
    for d in docs:
        gone = set()
        for i in range(len(d) - length + 1):
            if seen[tuple(d[i : i + length])] > 1:
                gone.update(range(i, i + length))
        out.append((len(d), len(gone), b" ".join(w for i, w in enumerate(d) if i not in gone).decode()))
    return out


def planted(rng, n):
    """Texts over few words that share passages, copies and periodic stretches."""
    words = [f"w{i}" for i in range(40)] + ["é", "日本", "a"]
    pool = [[rng.choice(words) for _ in range(rng.randrange(3, 30))] for _ in range(8)]
    out = []
    for _ in range(n):
        t = []
        for _ in range(rng.randrange(6)):
            kind = rng.random()
            t += rng.choice(pool) if kind < 0.5 else [rng.choice(words)] * rng.randrange(25) if kind < 0.65 else [rng.choice(words) for _ in range(rng.randrange(20))]
        out.append(rng.choice([" ", "\t", " \n "]).join(t))
    return out


@pytest.mark.parametrize("length, prefix, most", [(5, 2, 20_000), (7, 7, 20_000), (6, 3, 4), (1, 1, 20_000), (10, 1, 1), (35, 8, 20_000)])
def test_against_brute_force(spark, length, prefix, most):
    texts = planted(random.Random(length), 120) + [None, "", " ", "a", "a a a a a a a a a a a a", "b b b b b b b"]
    texts += texts[:4] + ["x " * 3000, "long " + "y z " * 2000]
    df = spark.createDataFrame([(i % 50, t, "c") for i, t in enumerate(texts)], "doc_id int, text string, key string").repartition(5)
    rows = op.dedup_substrings(df, length=length, prefix=prefix, most_segments=most).collect()
    want = {t: w for t, w in zip(texts, brute(texts, length))}
    assert len(rows) == len(texts)
    for r in rows:
        n, gone, kept = want[r.text]
        assert r.kept == kept and sum(s.end - s.start for s in r.removed_spans) == gone, r.text
        assert r.key == "c"


def test_query_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = {d.doc_id: (n, gone, hashlib.sha256(kept.encode()).hexdigest()) for d, (n, gone, kept) in zip(docs, brute([d.text for d in docs], 35))}
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in op.op5(spark, sf).collect()}
    assert got == want and any(gone for _, gone, _ in want.values())


def test_empty_table(spark):
    assert op.dedup_substrings(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_against_sql(spark):
    from tests.llm.duck import same_rows

    sf = "/root/testdata/sf0.01"
    same_rows(op.op5(spark, sf), op.OP5_SQL, sf)
