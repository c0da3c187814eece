import json

import numpy as np
import pytest

from ketframe.operators import diagnostics as d
from ketframe.operators import generate
from ketframe.plans import catalog
from ketframe.sources import artifacts, json_tree


@pytest.fixture(scope="module")
def dataset(spark):
    return generate.ising_dataset(spark, catalog.ISING | {"samples_per_class": 40}).cache()


def test_dataset_audit_and_floor(dataset):
    rows = d.dataset_audit(dataset, 4).collect()
    assert len(rows) == 6 and sum(r.n for r in rows) == 80
    assert all(max(r.norm_error, r.residual, r.energy_error, r.observable_error, r.phase_error) < 1e-10 for r in rows)
    assert all(r.g_max <= (0.8, 1.8)[r.label] for r in rows)
    assert all(r.distance < 1e-7 for r in d.numerical_floor(dataset, 4).collect())


def test_symmetries_hold(dataset):
    rows = d.symmetry_audit(dataset, 4).collect()
    assert len(rows) == 240 and all(r.commutator < 1e-12 for r in rows) and all(r.holds for r in rows if r.symmetry == "reflection")


def test_candidates(dataset):
    sources = dataset.where("split = 'train'")
    own = sources.select(d.F.concat(d.F.lit("c/"), "parameter_id").alias("candidate_id"), "label", d.F.array("parameter_id").alias("source_ids"), "state")
    rows = d.candidate_diagnostics(own, sources).collect()
    assert all(abs(r.source_fidelity - 1) < 1e-9 and r.nearest_same < 1e-6 and r.nearest_same_apart >= r.nearest_same and abs(r.energy_drift) < 1e-9 and r.margin > 0 for r in rows)
    lone = d.candidate_diagnostics(own.limit(1), sources.join(own.limit(1).select(d.F.col("source_ids")[0].alias("parameter_id")), "parameter_id")).first()
    assert lone.nearest_other is None or np.isnan(lone.nearest_other)


def test_freshness(dataset, spark):
    same = d.freshness(dataset, dataset).first()
    assert not same.fresh and same.shared_parameter_id == same.shared_digest == 80 and same.duplicates == 80 and same.nearest_overlap > 1 - 1e-9
    other = generate.ising_dataset(spark, catalog.ISING | {"samples_per_class": 20, "dataset_seed": 5}).withColumn("parameter_id", d.F.concat(d.F.lit("x"), "parameter_id"))
    new = d.freshness(other, dataset).first()
    assert new.fresh and new.separate


def test_hash_ignores_order(dataset):
    a = d.dataset_hash(dataset).first()
    assert a.n == 80 and d.dataset_hash(dataset.repartition(7)).first().digest == a.digest
    assert d.dataset_hash(dataset.limit(79)).first().digest != a.digest


def test_ensembles(dataset):
    m = {r.label: r for r in d.ensemble_metrics(dataset, dataset).collect()}
    assert all(abs(r.mmd) < 1e-9 and abs(r.nearest - 1) < 1e-9 and abs(r.mx_gap) < 1e-12 for r in m.values())
    part = d.ensemble_metrics(dataset.where("split = 'val' and label = 0"), dataset.where("split = 'train'")).collect()
    assert {r.label: r.mmd is None for r in part} == {0: False, 1: True}
    assert all(r.smallest > -1e-6 for r in d.gram_floor(dataset).collect())
    div = d.group_diversity(dataset, ["label"]).collect()
    for r in div:
        s = np.array([np.array(x.state.re) + 1j * np.array(x.state.im) for x in dataset.where(dataset.label == r.label).collect()])
        k = np.abs(s.conj() @ s.T) ** 2
        assert np.isclose(r.mean_fidelity, (k.sum() - len(s)) / (len(s) * (len(s) - 1)))


def test_artifacts(spark, tmp_path):
    p = np.arange(26, dtype=float).reshape(1, 2, 13)[:, :, :12]
    artifacts.write_checkpoint(spark, f"{tmp_path}/c", p, {0: 0.0, 1: 3.0}, 2, 1)
    got = artifacts.read_checkpoint(spark, f"{tmp_path}/c")
    assert np.array_equal(got["parameters"], p) and got["angles"] == {0: 0.0, 1: 3.0} and (got["n_data"], got["n_ancilla"]) == (2, 1)
    artifacts.write_checkpoint(spark, f"{tmp_path}/old", p, {0: 0.0})
    assert artifacts.read_checkpoint(spark, f"{tmp_path}/old")["n_data"] == 2
    (tmp_path / "j" / "deep").mkdir(parents=True)
    (tmp_path / "j" / "a.json").write_text(json.dumps({"id": "x", "rows": [{"g": 0.5, "id": "y"}, {"g": [1]}]}))
    (tmp_path / "j" / "deep" / "b.jsonl").write_text('{"id": "z"}\nbroken\n{"g": 2}')
    rows = json_tree.harvest_json(spark, f"{tmp_path}/j", ["id", "g"]).collect()
    assert sorted((r.name, r.value) for r in rows) == [("g", "0.5"), ("g", "2"), ("id", '"x"'), ("id", '"y"'), ("id", '"z"')]
    path = tmp_path / "f.bin"
    path.write_bytes(b"abc")
    import hashlib

    assert artifacts.verified_bytes(spark, str(path), hashlib.sha256(b"abc").hexdigest()) == b"abc"
    with pytest.raises(ValueError):
        artifacts.verified_bytes(spark, str(path), "0")
    both = artifacts.normalised_records({"a": spark.createDataFrame([("blocked-g",)], "regime string"), "b": spark.createDataFrame([(1,)], "g int")})
    assert sorted(str(r.regime) for r in both.collect()) == ["None", "blocked_g"]
