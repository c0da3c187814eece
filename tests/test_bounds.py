"""What one task holds: pieces of bounded size that add up to the whole."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ketframe.functions import linalg
from ketframe.operators import audit, metric_index, pairs, sampling, training


def test_bootstrap_holds_a_piece_of_the_draws_at_once():
    x = np.random.default_rng(1).standard_normal(20_000)
    tracemalloc.start()
    mean, interval = training.paired_bootstrap(x, 3, 2_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6
    rng = np.random.Generator(np.random.PCG64DXSM(np.random.SeedSequence(3)))
    assert interval == np.quantile(np.concatenate([x[rng.integers(0, len(x), (500, len(x)))].mean(1) for _ in range(4)]), [0.025, 0.975]).tolist()


def test_bootstrap_of_a_group_in_stretches(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [("a", float(x)) for x in rng.exponential(2.0, 900)] + [("b", 1.0)] * 300 + [("b", float("nan")), (None, 2.0), ("c", None)]
    df = spark.createDataFrame(rows, "arm string, delta double")
    whole = {r.group: r for r in training.bootstrap_intervals(df, "arm", "delta", seed=3).collect()}
    x = np.sort([v for k, v in rows if k == "a"])
    mean, (low, high) = training.paired_bootstrap(x, 3, 10_000)
    assert (whole["a"].n, whole["a"]["mean"], whole["a"].low, whole["a"].high) == (900, mean, low, high)
    monkeypatch.setattr(training, "STRETCH_PLACES", 128)
    cut = {r.group: r for r in training.bootstrap_intervals(df, "arm", "delta", seed=3).collect()}
    assert {k: r.n for k, r in cut.items()} == {k: r.n for k, r in whole.items()} == {"a": 900, "b": 300, None: 1, "c": 0}
    assert abs(cut["a"]["mean"] - mean) < 1e-12 and abs(cut["a"].low - low) < 0.01 and abs(cut["a"].high - high) < 0.01
    assert abs(cut["b"].low - 1) < 1e-12 and abs(cut["b"].high - 1) < 1e-12 and cut["c"].low is None


def test_shares_of_stretches_are_multinomial():
    m = np.stack([training._drawn(1_000, 300, k, 3, 0, 4_000) for k in range(4)])
    assert (m.sum(0) == 1_000).all() and np.allclose(m.mean(1), [300, 300, 300, 100], atol=2)
    assert np.allclose(m.var(1), [210, 210, 210, 90], rtol=0.1) and abs(np.cov(m)[0, 3] + 30) < 8


def test_blocks_grow_with_the_table_so_that_a_row_is_sent_a_fixed_number_of_times(spark):
    rows = spark.range(60_000).select("id", F.array(F.lit(1.0)).alias("state"))
    out = pairs.block_pairs(rows, lambda left, right, same: iter([pd.DataFrame({"x": [len(left)], "y": [0 if same else len(right)]})]), "x long, y long", tiled=False).collect()
    assert len(out) == pairs.BLOCKS * (pairs.BLOCKS + 1) // 2
    assert sum(r.x for r in out if not r.y) == 60_000


def test_a_unit_sends_what_it_keeps_as_it_is_found(spark):
    """The resident MB of the worker do not grow with the rows that one unit keeps, 240 MB here."""

    def keep(left, right, same):
        for _ in range(150):
            with open("/proc/self/statm") as f:
                yield pd.DataFrame({"x": np.arange(200_000), "mb": int(f.read().split()[1]) * 4096 >> 20})

    rows = spark.range(10).select("id", F.array(F.lit(1.0)).alias("state"))
    got = pairs.block_pairs(rows, keep, "x long, mb int", tiled=False).agg(F.count("*").alias("n"), F.min("mb").alias("low"), F.max("mb").alias("high")).first()
    assert got.n == 30_000_000 and got.high - got.low < 100, got


@pytest.mark.parametrize("share", [-1.0, 2.0])  # by blocks, through the cells
def test_states_with_neighbours_are_told_once(spark, monkeypatch, share):
    for name, value in (("SMALL", 0), ("MOST_VISITED", share), ("TILE", 32), ("AIM", 16)):
        monkeypatch.setattr(metric_index, name, value)
    monkeypatch.setattr(pairs, "BLOCK_ROWS", 90)
    x = linalg.normalized(np.random.default_rng(8).standard_normal((240, 6)))
    x[200:] = x[:40]
    df = spark.createDataFrame([(i * 3, v.tolist()) for i, v in enumerate(x)], "id long, state array<double>")
    for least in (0.85, 0.97):
        near = (x @ x.T) ** 2 >= least
        np.fill_diagonal(near, False)
        got = sorted(r.id for r in metric_index.with_neighbours(df, least).collect())
        assert got == [3 * i for i in np.flatnonzero(near.any(1))] and 80 <= len(got) < 240
    assert metric_index.with_neighbours(df.limit(0), 0.5).count() == 0


def test_cosines_are_added_up_in_the_unit(spark, monkeypatch):
    monkeypatch.setattr(pairs, "TILE", 7)
    rng = np.random.default_rng(5)
    x = rng.standard_normal((60, 4))
    label = rng.integers(0, 3, 60)
    df = spark.createDataFrame([(i, int(k), v.tolist()) for i, (k, v) in enumerate(zip(label, x))], "id long, label int, state array<double>")
    got = {r.same_class: r for r in audit.cosine_groups(df).collect()}
    c, agree, upper = x @ x.T, label[:, None] == label, np.triu(np.ones((60, 60), bool), 1)
    for k in (True, False):
        of = c[upper & (agree == k)]
        assert got[k].pairs == len(of) and np.allclose([got[k]["mean"], got[k].positive, got[k].negative], [of.mean(), (of > 0).mean(), (of < 0).mean()])


def test_fidelity_of_states_that_lack_a_qubit_needs_no_roots():
    rng = np.random.default_rng(4)
    for n in (2, 3, 4):
        z = linalg.normalized(rng.standard_normal((12, 2**n)) + 1j * rng.standard_normal((12, 2**n)))
        for x in (z, linalg.normalized(z.real)):
            kept = [[q for q in range(n) if q != lost] for lost in range(n)]
            want = sum(linalg.density_fidelity(linalg.reduced(x, q), linalg.reduced(x, q)) for q in kept) / n
            got = linalg.rdm_kernel(x, x, n - 1)
            assert np.abs(got - want).max() < 1e-7 and np.abs(got.diagonal() - 1).max() < 1e-12


def test_alike_states_meet_by_blocks(spark, monkeypatch):
    for name, value in (("SMALL", 0), ("MOST_VISITED", -1.0), ("TILE", 32)):
        monkeypatch.setattr(metric_index, name, value)
    monkeypatch.setattr(pairs, "BLOCK_ROWS", 40)
    rng = np.random.default_rng(6)
    x = linalg.normalized(rng.standard_normal((240, 6)))
    x[200:] = x[rng.integers(0, 60, 40)]  # copies, which tie
    label = rng.integers(0, 2, 240)
    df = spark.createDataFrame([(i, int(k), v.tolist()) for i, (k, v) in enumerate(zip(label, x))], "id long, label int, state array<double>")
    c = np.abs(x @ x.T)
    f, same = c**2, label[:, None] == label
    got = metric_index.near_duplicate_pairs(df, 0.5).collect()
    assert sorted((r.a, r.b) for r in got) == list(zip(*np.nonzero(np.triu(f >= 0.5, 1))))
    assert metric_index.compared(df, 0.5).first().met == 240**2
    got = metric_index.near_duplicate_pairs(df, 0.5, within=["label"]).collect()
    assert sorted((r.a, r.b) for r in got) == list(zip(*np.nonzero(np.triu((f >= 0.5) & same, 1))))
    for within, allowed in (([], np.ones_like(same)), (["label"], same)):
        ranked = np.where(allowed & ~np.eye(240, dtype=bool), np.round(c, 9), -1.0)
        want = [(i, int(j), k + 1) for i in range(240) for k, j in enumerate(np.lexsort((np.arange(240), -ranked[i]))[:3])]
        assert sorted((r.id, r.neighbour, r["rank"]) for r in metric_index.nearest(df, 3, within=within).collect()) == sorted(want)


def test_visits_are_handed_on_in_batches(spark, monkeypatch):
    monkeypatch.setattr(metric_index, "AIM", 8)
    monkeypatch.setattr(metric_index, "VISITS", 50)
    x = linalg.normalized(np.random.default_rng(7).standard_normal((400, 8)))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, state array<double>")
    index = metric_index.Index(df, [])
    went = index.visits(index.rows.withColumn("radius", F.lit(1.0)), None)
    sizes = went.mapInPandas(lambda frames: (pd.DataFrame({"n": [len(f)]}) for f in frames), "n long").agg(F.sum("n")).first()[0]
    f = np.triu((x @ x.T) ** 2 >= 0.3, 1)
    assert sizes > 400 * 10 and metric_index.near_duplicate_pairs(df, 0.3).count() == f.sum()


def test_only_a_component_that_fits_nowhere_is_cut(spark):
    x = linalg.normalized(np.r_[np.tile([[1.0, 0, 0, 0]], (30, 1)), np.tile([[0, 1.0, 0, 0]], (4, 1)), np.tile([[0, 0, 1.0, 0]], (3, 1)), np.tile([[0, 0, 0, 1.0]], (3, 1))])
    df = spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(x)], "id long, label int, state array<double>")
    split = {r.id: r.split for r in sampling.component_split(df, {"train": 0.5, "val": 0.25, "test": 0.25}, 0.9, part_large=True).collect()}
    assert sorted(split) == list(range(40)) and [list(split.values()).count(s) for s in ("train", "val", "test")] == [20, 10, 10]
    assert all(len({split[i] for i in ids}) == 1 for ids in (range(30, 34), range(34, 37), range(37, 40)))
