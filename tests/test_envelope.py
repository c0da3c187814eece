import random

import numpy as np
import pandas as pd
import pytest

from ketframe.operators import envelope, ranks


def test_layers_hold_the_two_largest_lines():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 8, 200):
        m, c = rng.integers(-6, 7, n) * 1.0, rng.integers(-9, 10, n) * 1.0
        first, second = envelope.two_layers(pd.DataFrame({"slope": m, "height": c, "copies": 1}))
        for g in np.linspace(-9, 9, 40):
            want = sorted({(a, b) for a, b in zip(m, c)}, key=lambda x: -(x[0] * g + x[1]))[:2]
            kept = pd.concat([first, second])
            got = np.sort((kept["slope"] * g + kept["height"]).to_numpy())[::-1][:2]
            assert np.allclose(got, [a * g + b for a, b in want])


@pytest.mark.parametrize("integers", [True, False])
def test_against_all_pairs(spark, integers):
    rng = random.Random(5)
    x = (lambda: float(rng.randrange(-4, 5))) if integers else (lambda: rng.gauss(0, 1))
    rows = [(rng.choice([1, 1, 1, 2, None]), x(), x(), x()) for _ in range(250)] + [(7, 0.5, 1.0, 1.0), (8, 1.0, 2.0, 0.0), (8, 1.0, 2.0, 0.0), (9, 1.0, 0.0, 1.0), (9, 2.0, 0.0, 0.0)]
    rows += [(1, None, 1.0, 9e9), (1, 0.0, float("nan"), 1.0), (2, 1.0, float("inf"), 0.0), (1, 0.0, 0.0, None)]
    df = spark.createDataFrame([(i, *r, "x") for i, r in enumerate(rows)], "id int, k int, g double, m double, c double, first string").repartition(5)
    got = envelope.largest_other(df, ["k"], "g", "m", "c")
    assert got.columns == [*df.columns, "largest_other"]
    found = {r.id: r.largest_other for r in got.collect()}
    clean = [None if r[1] is None or r[2] is None or r[3] is None or not np.isfinite(r[1:]).all() else r for r in rows]
    for i, r in enumerate(clean):
        near = [q[2] * r[1] + q[3] for j, q in enumerate(clean) if j != i and q and q[0] == r[0]] if r else []
        assert found[i] == (pytest.approx(max(near), abs=1e-9) if near else None), (i, rows[i])


def test_tangents_of_a_parabola_all_stay_and_an_empty_table(spark):
    rows = [(0, t / 10, 2 * t / 10, -((t / 10) ** 2)) for t in range(200)]  # each is largest at its own place
    df = spark.createDataFrame(rows, "k int, g double, m double, c double")
    got = {round(r.g, 3): r.largest_other for r in envelope.largest_other(df, ["k"], "g", "m", "c").collect()}
    assert len(got) == 200 and all(abs(v - (g * g - 0.01)) < 1e-9 for g, v in got.items())
    assert envelope.largest_other(df.limit(0), ["k"], "g", "m", "c").count() == 0


def test_latest_value_across_stretches(spark):
    rng = random.Random(2)
    rows = [(rng.choice([0, 0, 0, 1, None]), i, rng.choice([None] * 30 + [i])) for i in range(600)]
    got = ranks.latest(spark.createDataFrame(rows, "k int, i int, v int").repartition(7), ["k"], ["i"], ["v"]).collect()
    last, want = {}, {}
    for k, i, v in rows:
        last[k] = v if v is not None else last.get(k)
        want[i] = last[k]
    assert {r.i: r.v for r in got} == want
