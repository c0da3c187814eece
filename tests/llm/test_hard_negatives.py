import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ketframe.llm import hard_negatives as op
from tests.llm.duck import same_rows

KIND = "vec_id long, label int, embedding array<double>, id string, codes int"


def slow(rows, every=100, scale=256, k=5):
    """All pairs in Python's integers."""
    known = {}
    for i, label, vec in rows:
        if i is None or label is None or vec is None or any(x is None or not math.isfinite(x) for x in vec):
            continue
        v = (label, list(vec))
        known[i] = min(known.get(i, v), v)
    whole = {i: (label, [math.floor(x * scale) for x in v]) for i, (label, v) in known.items()}
    out = set()
    for a, (label, v) in whole.items():
        if a % every:
            continue
        score = {i: sum(x * y for x, y in zip(v, w)) for i, (_, w) in whole.items() if i != a}
        best = sorted((-s, i) for i, s in score.items() if whole[i][0] == label)[:k]
        for p, positive in best:
            window = sorted((-s, i) for i, s in score.items() if whole[i][0] != label and 80 * -p <= 100 * s <= 100 * -p)[:k]
            out |= {(a, positive, rank, i, -p, -s) for rank, (s, i) in enumerate(window, 1)}
    return out


def mined(spark, rows, every=100, **kw):
    df = spark.createDataFrame([(i, label, v, "x", 1) for i, label, v in rows], KIND)
    out = op.mine_hard_negatives(df, F.col("id") % every == 0, **kw)
    assert [f"{c} {t}" for c, t in out.dtypes] == op.RESULT.replace("long", "bigint").split(", ")
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_against_sql(spark, sf):
    same_rows(op.op13(spark, sf), op.OP13_SQL, sf)


@pytest.mark.parametrize("case", ["spread", "copies", "hot label", "coarse"])
def test_all_pairs(spark, case):
    rng = np.random.default_rng(3)
    n = 900
    x = rng.standard_normal((n, 9)) / 3
    labels = rng.integers(0, 4, n)
    if case == "copies":
        x[rng.random(n) < 0.4] = x[0]
    if case == "hot label":
        labels[rng.random(n) < 0.7] = 1
    if case == "coarse":
        x = np.rint(x * 3) / 3
    rows = [(int(i), int(label), v.tolist()) for i, label, v in zip(rng.permutation(n), labels, x)]
    want = slow(rows, every=30)
    assert want and mined(spark, rows, every=30) == want


def test_blocks_of_anchors(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, int(rng.integers(3)), rng.standard_normal(6).tolist()) for i in range(400)]
    monkeypatch.setattr(op, "ANCHOR_BLOCK", 20)
    monkeypatch.setattr(op, "TILE_ANCHORS", 4)
    monkeypatch.setattr(op, "SAMPLE", 50)
    assert mined(spark, rows, every=5) == slow(rows, every=5)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 0.5]), (1, 1, [0.9, 0.5]), (1, 1, [0.9, 0.5]), (2, 2, [0.9]), (3, 2, [nan, 1.0]), (4, 2, [inf, 1.0]), (5, None, [1.0, 1.0]), (6, 2, None), (7, 2, [None, 1.0]),
            (None, 2, [1.0, 1.0]), (8, 2, []), (9, 2, [0.95, 0.4, 0.0]), (100, 3, [-1.0, -1.0]), (101, 3, [1.0, 1.0]), (102, 2, [0.95, 0.4]), (9, 1, [2.0, 0.0])]
    assert mined(spark, rows) == slow(rows)
    assert mined(spark, []) == set() and mined(spark, [(1, 1, [1.0])]) == set() and mined(spark, [(0, 1, [])]) == set()


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(5)
    rows = [(i, int(rng.integers(2)), (rng.standard_normal(3) * 1e6 + rng.integers(0, 5, 3) / 256).tolist()) for i in range(60)]
    assert mined(spark, rows, every=10) == slow(rows, every=10)


def test_intervals_hold_the_score():
    rng = np.random.default_rng(6)
    x = np.floor(rng.standard_normal((500, 7)) * 256)
    q = op.Quantiser(op.codebooks(x[:40], 7), 7, True)
    codes, residuals = q.index(x)
    about = sum(t[:, c] for t, c in zip(q.tables(x[:20]), codes.T))
    off = q.lengths(x[:20]) @ residuals.T
    true = x[:20] @ x.T
    assert (np.abs(true - about) <= off).all() and (off < np.abs(true).max()).mean() > 0.5
