"""The index, selection of quantiles, feature maps, greedy rounds and ranks against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ketframe.functions import linalg
from ketframe.operators import metric_index, mmd, pairs, ranks, sampling

KIND = "id long, label int, split string, state array<double>"


def rows_of(case, n=260):
    rng = np.random.default_rng(7)
    if case == "clusters":
        x = rng.standard_normal((12, 6))[rng.integers(0, 12, n)] + 0.05 * rng.standard_normal((n, 6))
    elif case == "copies":
        x = rng.standard_normal((n, 4))
        x[rng.random(n) < 0.4] = x[0]
    else:
        x = rng.standard_normal((n, 3))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return [(int(i), int(k % 3), "xyz"[(k // 3) % 3], v.tolist()) for k, (i, v) in enumerate(zip(rng.permutation(n), x))]


@pytest.fixture(params=["clusters", "copies", "spread"])
def table(request, spark, monkeypatch):
    monkeypatch.setattr(metric_index, "AIM", 16)
    monkeypatch.setattr(metric_index, "CELL_ROWS", 20)
    rows = rows_of(request.param)
    return spark.createDataFrame(rows, KIND), {r[0]: (r[1], r[2], np.array(r[3])) for r in rows}


def test_near_pairs(table):
    df, rows = table
    ids = sorted(rows)
    m = np.stack([rows[i][2] for i in ids])
    f = (m @ m.T) ** 2
    for least in (0.5, 0.99):
        want = {(ids[i], ids[j]) for i, j in zip(*np.nonzero(f >= least)) if i < j}
        got = [(r.a, r.b) for r in metric_index.near_duplicate_pairs(df, least).collect()]
        assert len(got) == len(set(got)) and set(got) == want
        same = {(a, b) for a, b in want if rows[a][0] == rows[b][0]}
        assert {(r.a, r.b) for r in metric_index.near_duplicate_pairs(df, least, within=["label"]).collect()} == same
    near = metric_index.near_duplicate_pairs(df, 0.99)
    both = near.select("a", "b").unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    assert both.count() == 2 * len(want)
    effort = metric_index.compared(df, 0.99).first()
    assert effort.rows == len(rows) and effort.found == len(want) and effort.met < len(rows) ** 2


@pytest.mark.parametrize("within", [[], ["label"]])
def test_nearest(table, within):
    df, rows = table
    got = {}
    for r in metric_index.nearest(df, 3, within=within).collect():
        got.setdefault(r.id, []).append((r["rank"], r.neighbour, r.overlap))
    for i, (label, _, v) in rows.items():
        others = sorted((-abs(float(v @ w)), j) for j, (k, _, w) in rows.items() if j != i and (not within or k == label))[:3]
        mine = sorted(got[i])
        assert np.allclose([o for _, _, o in mine], [-c for c, _ in others], atol=1e-12)
        assert [k for k, _, _ in mine] == [1, 2, 3] and len({j for _, j, _ in mine}) == 3


def test_closest_across(table):
    df, rows = table
    want = {}
    for i, (_, s, v) in rows.items():
        for j, (_, t, w) in rows.items():
            if s < t:
                want[s, t] = max(want.get((s, t), 0), abs(float(v @ w)))
    got = {(r.split_a, r.split_b): r.overlap for r in metric_index.closest_across(df, "split").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_index_of_nothing_and_of_one(spark):
    for rows in ([], [(1, 0, "x", [1.0, 0.0])]):
        df = spark.createDataFrame(rows, KIND)
        assert metric_index.near_duplicate_pairs(df, 0.5).count() == 0 and metric_index.nearest(df, 2).count() == 0 and metric_index.closest_across(df, "split").count() == 0


def test_effort_grows_below_the_square(spark):
    """States of one real parameter, as ground states along a field are: twice the rows cost about twice the pairs."""
    met = []
    for n in (2_000, 8_000):
        t = np.random.default_rng(1).random(n) * np.pi
        df = spark.createDataFrame([(i, 0, "x", [float(np.cos(a)), float(np.sin(a))]) for i, a in enumerate(t)], KIND)
        r = metric_index.compared(df, float(np.cos(1e-4) ** 2)).first()
        met.append(r.met / n**2)
    assert met[0] < 0.3 and met[1] < 0.4 * met[0]


@pytest.mark.parametrize("few", [1, 40, 10**6])
def test_pair_quantiles(table, monkeypatch, few):
    df, rows = table
    monkeypatch.setattr(pairs, "FEW", few)
    shares = {"q0": 0.0, "q1": 0.1, "q5": 0.5, "q9": 0.93, "q10": 1.0}
    got = {r.label: r for r in pairs.pair_quantiles(df, shares, ["label"], block_rows=30).collect()}
    for label in range(3):
        m = np.stack([v for k, _, v in rows.values() if k == label])
        c = np.abs(m @ m.T)[np.triu_indices(len(m), 1)]
        d = np.arccos(np.minimum(c, 1))
        assert got[label].pairs == len(d) and abs(got[label].mean_fidelity - (c**2).mean()) < 1e-9
        assert np.allclose([got[label][k] for k in shares], np.quantile(d, list(shares.values())), atol=1e-7)
    assert pairs.pair_quantiles(df.limit(0), shares, ["label"]).count() == 0
    assert pairs.pair_quantiles(df.where("id < 2"), {"q5": 0.5}).first().pairs == 1


def test_totals_without_pairs(table):
    df, rows = table
    ids = sorted(rows)
    m = np.stack([rows[i][2] for i in ids])
    for cosine in (True, False):
        got = {r.id: r for r in pairs.totals_to_others(df, cosine).collect()}
        c = m @ m.T if cosine else (m @ m.T) ** 2
        np.fill_diagonal(c, 0)
        assert np.allclose([got[i].total for i in ids], c.sum(1), atol=1e-9) and {r.n for r in got.values()} == {len(ids) - 1}


def test_kernels_without_tasks_of_a_side(spark):
    rng = np.random.default_rng(2)
    z = rng.standard_normal((40, 8)) + 1j * rng.standard_normal((40, 8))
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    side = np.array(["a", "b", "c"])[rng.integers(0, 3, 40)]
    kind = "id long, g int, side string, state struct<re: array<double>, im: array<double>>"
    df = spark.createDataFrame([(i, 1, s, (v.real.tolist(), v.imag.tolist())) for i, (s, v) in enumerate(zip(side, z))], kind)
    for got, kernel in ((mmd.qubit_kernel_mmd(df, "side", 3, ["g"]), "1-rdm"), (mmd.blocked_kernel_mmd(df, "side", "2-rdm", ["g"], 7), "2-rdm"), (mmd.blocked_kernel_mmd(df, "side", "global", ["g"], 7), "global")):
        found = {(r.a, r.b): r.mmd for r in got.collect()}
        assert len(found) == 3
        for (a, b), value in found.items():
            assert abs(value - linalg.mmd(z[side == a], z[side == b], kernel)) < 1e-9


def test_greedy_rounds_equal_the_sequence(table):
    df, rows = table
    for tolerance in (0.3, 0.75):
        kept, rounds = sampling.greedy_kept(df, "label", tolerance)
        want = []
        for i in sorted(rows):
            label, _, v = rows[i]
            if all(rows[j][0] != label or (rows[j][2] @ v) ** 2 < 1 - tolerance for j in want):
                want.append(i)
        assert sorted(r.id for r in kept.collect()) == want and rounds < 15


def test_running_sums_ranks_and_neighbours(spark):
    rng = np.random.default_rng(3)
    data = [(None if g == 3 else int(g), int(x), i) for i, (g, x) in enumerate(zip(np.minimum(rng.integers(0, 9, 500), 3), rng.integers(0, 60, 500)))]
    df = spark.createDataFrame(data, "g int, x int, id int").repartition(5)
    want = {}
    for g, x, i in sorted(data, key=lambda r: (r[0] is None, r[0], r[1], r[2])):
        want.setdefault(g, []).append((x, i))
    order = ["x", "id"]
    got = {(r.g, r.id): (r["rank"], r.total) for r in ranks.running_sums(df, ["g"], order, {"rank": F.lit(1).cast("long"), "total": F.col("x")}).collect()}
    after = {(r.g, r.id): r.next for r in ranks.following(df, ["g"], order, "id", "next").collect()}
    mean = {(r.g, r.id): r.r for r in ranks.average_ranks(df, ["g"], "x", "r").collect()}
    assert len(got) == len(after) == len(mean) == len(data)
    for g, rows in want.items():
        total = 0
        for k, (x, i) in enumerate(rows):
            total += x
            assert got[g, i] == (k + 1, total) and after[g, i] == (rows[k + 1][1] if k + 1 < len(rows) else None)
            places = [j + 1 for j, (y, _) in enumerate(rows) if y == x]
            assert mean[g, i] == sum(places) / len(places)


def test_components_and_split(spark):
    rng = np.random.default_rng(4)
    chain = [(i, i + 1) for i in range(30, 50)] + [(1, 9), (9, 4), (2, 3), (3, 2)]
    got = {r.id: r.root for r in sampling.conflict_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 30 for i in range(30, 51)}, 1: 1, 9: 1, 4: 1, 2: 2, 3: 2}
    assert sampling.conflict_components(spark.createDataFrame([], "a long, b long")).count() == 0

    x = rng.standard_normal((300, 12))
    x[:40] = x[100:140] + 0.02 * rng.standard_normal((40, 12))  # near states of another label, mostly
    x[40:60] = x[200] + 0.01 * rng.standard_normal((20, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, int(rng.integers(3)), "x", v.tolist()) for i, v in enumerate(x)]
    shares = {"train": 0.7, "val": 0.15, "test": 0.15}
    out = sampling.component_split(spark.createDataFrame(rows, KIND), shares, 0.95).collect()
    split = {r.id: r.split for r in out}
    assert len(out) == len(split) == 300
    f = (x @ x.T) ** 2
    assert all(split[i] == split[j] for i, j in zip(*np.nonzero(f >= 0.95)))
    for label in range(3):
        n = sum(r[1] == label for r in rows)
        got = [sum(r[1] == label and split[r[0]] == s for r in rows) for s in shares]
        assert sum(got) == n and np.abs(np.array(got) - np.array(list(shares.values())) * n).max() <= 1


def test_a_component_that_fits_nowhere_is_an_error(spark):
    rows = [(i, 0, "x", [1.0, 0.0]) for i in range(4)]
    with pytest.raises(Exception, match="fits no split"):
        sampling.component_split(spark.createDataFrame(rows, KIND), {"a": 0.5, "b": 0.5}, 0.9).collect()
