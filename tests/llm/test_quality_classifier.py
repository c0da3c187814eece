import zlib

import numpy as np

from ketframe.llm import quality_classifier as op


def test_isotonic_is_the_best_monotone_fit():
    rng = np.random.default_rng(0)
    for _ in range(30):
        n = rng.integers(1, 9)
        count, y = rng.integers(0, 4, n), rng.random(n)
        count[rng.integers(n)] += 1
        got = op.isotonic(count, count * y)
        assert (np.diff(got) >= -1e-12).all()
        loss = lambda f: (count * (f - y) ** 2).sum()  # noqa: E731, B023
        for _ in range(200):
            other = np.sort(rng.random(n))
            assert loss(got) <= loss(other) + 1e-12


def test_features_approximate_the_kernel():
    model = op.Model(features=20_000)
    x = np.random.default_rng(1).standard_normal((6, len(op.STATISTICS)))
    z = model.features(x)[:, 1 + len(op.STATISTICS) :]
    want = np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / (2 * op.WIDTH**2))
    assert np.abs(z @ z.T - want).max() < 0.04


def test_partition_sums_equal_direct_solution(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = op.materialize(op.add_statistics(docs).drop("text"), "statistics")
    model = op.fit(rows.repartition(7), labels, "doc_id", "quality")
    y = {r.doc_id: r.quality for r in labels.collect()}
    all_rows = [(r.doc_id, np.array(r.statistics)) for r in rows.collect()]
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    x = np.array([s for i, s in all_rows if i in y and fold(i) > 1])
    t = np.array([y[i] for i, s in all_rows if i in y and fold(i) > 1], float)
    assert np.allclose(model.mean, x.mean(0)) and len(x)
    z = model.features(x)
    penalty = op.RIDGE * len(x) * np.eye(model.size)
    penalty[0, 0] = 0
    assert np.allclose(z @ model.weights, z @ np.linalg.solve(z.T @ z + penalty, z.T @ t), atol=1e-6)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    y = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = op.op10(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    test = [(r.predicted, y[r.doc_id]) for r in rows if r.held_out and r.doc_id in y]
    assert sum(p == t for p, t in test) >= 0.95 * len(test)
    bad = [p for p, t in test if t == 0]
    assert bad and sum(bad) <= 0.2 * len(bad)


def test_edges(spark):
    rows = [(i, t, "q", 5) for i, t in [(1, None), (2, ""), (2, ""), (None, "x"), (3, "w " * 50_000), (4, "é日本\x00\n"), (5, "!!! |"), (6, "a b"), (7, "a c"), (8, "b c")]]
    df = spark.createDataFrame(rows, "doc_id int, text string, score string, statistics int")
    labels = spark.createDataFrame([(i, q, 0) for i, q in [(1, 1), (2, 0), (2, 1), (5, None), (None, 1), (6, 1), (7, 1), (8, 0), (4, 1)]], "doc_id int, quality int, text int")
    for known in (labels, labels.limit(0), labels.where("quality = 1")):
        got = op.classify_quality(df, known).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.statistics == 5 for r in got)
    assert {r.score for r in op.classify_quality(df, labels.limit(0)).collect()} == {0.5}
    assert op.classify_quality(df.limit(0), labels).count() == 0
