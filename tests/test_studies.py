import numpy as np
import pytest

from ketframe.operators import generate
from ketframe.plans import catalog, studies
from ketframe.sources import tables
from ketframe.streaming import grouped


@pytest.fixture(scope="module")
def dataset(spark):
    return generate.ising_dataset(spark, catalog.ISING).cache()


SEEDS = [(1000, 2000), (1001, 2001)]


def test_baseline_sweep(dataset):
    runs, summary = studies.baseline_sweep(dataset, [5, 10], SEEDS, steps=30)
    rows = {r["size"]: r for r in summary.collect()}
    assert set(rows) == {5, 10} and all(r.completed == 2 and r.failed == 0 and 0.4 < r.test_accuracy_mean <= 1 for r in rows.values())
    assert runs.count() == 4


def test_arms(dataset):
    summary, comparison = studies.unitary_study(dataset, 5, [0.0, 0.1], [0.5, 1.0], SEEDS, steps=10)
    assert {r.strength for r in summary.collect()} == {0.0, 0.1}
    rows = comparison.collect()
    assert {r.arm for r in rows} == {"unitary-0.50", "unitary-1.00"} and all(r.wins + r.ties + r.losses == r.n == 2 for r in rows)
    other = studies.geometry_study(dataset, 6, [1.0], SEEDS, steps=5).collect()
    assert {r.arm for r in other} == {"geodesic-1.00", "control-1.00", "tangent-1.00"}


def test_radius_calibration(spark, dataset):
    blocked = generate.ising_dataset(spark, catalog.BLOCKED)
    cells, grid = studies.radius_calibration({"random": dataset, "blocked": blocked})
    assert cells.count() == 2 * 2 * 3 * 3 * 3
    rows = {(r.radius, r.ratio): r for r in grid.collect()}
    assert len(rows) == 9 and all(r.cells == r.valid_cells == 12 and r.accepted == r.requested == 120 * r.ratio for r in rows.values())
    assert all(r.anchor_coverage == min(r.ratio, 1.0) for r in rows.values())
    assert [k for k, r in rows.items() if r.selected] == [("medium", 1.0)]


def test_calibration_refuses_near_duplicates(dataset, monkeypatch):
    monkeypatch.setattr(generate, "NEAR_INFIDELITY", 2.0)
    _, grid = studies.radius_calibration({"random": dataset}, run_seeds=(0,))
    assert not any(r.eligible or r.selected for r in grid.collect())


def test_kernels_and_gradients(spark):
    rows, pearson = studies.kernel_study(spark, [1, 2], count=4, layers=1, updates=3)
    assert rows.count() == 12 and {r.kernel for r in pearson.collect()} == {"global", "1-rdm", "2-rdm"}
    cells, conflicts = studies.gradient_study(spark, count=3, realisations=2, directions=6)
    assert cells.count() == 24
    got = conflicts.collect()
    assert len(got) == 4 and all(-1 <= r.score <= 1 for r in got) and np.isclose(sum(r.weight for r in got), 2)


def test_tables(spark, dataset, tmp_path):
    path = f"{tmp_path}/states"
    tables.write_state_table(dataset, path)
    train = tables.read_states(spark, path, "train")
    assert train.count() == 280 and "PartitionFilters: [isnotnull(split" in train._jdf.queryExecution().toString()
    with pytest.raises(FileExistsError):
        tables.write_state_table(dataset, path)
    sums = tables.checksums(spark, path).cache()
    assert {r.status for r in tables.compare_checksums(sums, sums).collect()} == {"ok"}
    changed = sums.limit(1).select("file", tables.F.lit("x").alias("sha256"))
    status = [r.status for r in tables.compare_checksums(sums, changed).collect()]
    assert "changed" in status and "extra" in status and tables.tree_hash(sums).first().tree != tables.tree_hash(changed).first().tree
    manifest = dataset.select("parameter_id", "label", "split", "pos")
    states = dataset.select("parameter_id", "label", "state")
    assert tables.join_manifest(states, manifest).count() == 400
    for bad in (states.limit(399), states.union(states.limit(1)), states.withColumn("label", 1 - tables.F.col("label"))):
        with pytest.raises(Exception):
            tables.join_manifest(bad, manifest).count()
    with pytest.raises(ValueError):
        tables.write_json_report(spark, {"x": float("nan")}, f"{tmp_path}/r")
    tables.write_json_report(spark, {"b": 1, "a": 2}, f"{tmp_path}/report")
    assert "".join(r.value for r in spark.read.text(f"{tmp_path}/report").collect()).index('"a"') < 10
    wide = tables.union_rows([spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([("x",)], "b string")])
    assert wide.columns == ["a", "b"] and wide.count() == 2
    tables.write_csv(wide, f"{tmp_path}/csv")
    tables.write_markdown(spark, wide, "Rows", f"{tmp_path}/md")


def test_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(f"{tmp_path}/in")
    stream = grouped.windowed_stats(grouped.read_stream(spark, f"{tmp_path}/in", events), "ts", "event_type", "value", "1 hour", "3650 days")
    grouped.write_windows(stream, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination(120)
    batch = {(r.start, r.group): (r.n, round(r.mean, 9)) for r in grouped.windowed_stats(events, "ts", "event_type", "value", "1 hour").collect()}
    done = grouped.windowed_stats(grouped.read_stream(spark, f"{tmp_path}/in", events, 9), "ts", "event_type", "value", "1 hour", "1 hour")
    query = done.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {(r.start, r.group): (r.n, round(r.mean, 9)) for r in spark.table("windows").collect()} == batch


def test_evidence_and_reproducibility(spark, tmp_path):
    folder = tmp_path / "evidence"
    folder.mkdir()
    for name in "abc":
        (folder / name).write_text(f"content of {name}")
    pinned = spark.createDataFrame(tables.checksums(spark, str(folder)).collect())
    assert pinned.count() == 3 and tables.changed_evidence(tables.checksums(spark, str(folder)), pinned).count() == 0
    first = {(r.kind, r.name): r.value for r in tables.reproducibility_record(spark, {"b": 1, "a": [2]}, str(folder), {"all": str(folder)}).collect()}
    (folder / "a").write_text("another")
    (folder / "b").unlink()
    (folder / "d").write_text("new")
    got = {r.file: r.status for r in tables.changed_evidence(tables.checksums(spark, str(folder)), pinned).collect()}
    assert got == {"a": "changed", "b": "missing"}
    second = {(r.kind, r.name): r.value for r in tables.reproducibility_record(spark, {"a": [2], "b": 1}, str(folder), {"all": str(folder)}).collect()}
    assert first["config", "config"] == second["config", "config"] and first["source", "c"] == second["source", "c"]
    assert first["dataset", "all"] != second["dataset", "all"] and ("source", "b") not in second and ("version", "spark") in second


def test_markdown_says_what_is_left_out(spark, tmp_path):
    tables.write_markdown(spark, spark.range(7).orderBy("id"), "T", f"{tmp_path}/m", most=3)
    text = "\n".join(r.value for r in spark.read.text(f"{tmp_path}/m").collect())
    assert "4 more rows are not shown." in text and "| 2 |" in text and "| 3 |" not in text
