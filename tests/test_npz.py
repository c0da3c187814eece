import json

import numpy as np
import pytest

from ketframe.sources import npz


def write(path, n=100, compressed=False, seed=1):
    rng = np.random.default_rng(seed)
    states = rng.normal(size=(n, 8)) + 1j * rng.normal(size=(n, 8))
    arrays = {"states": states, "labels": np.arange(n, dtype=np.int8) % 2, "parameter_ids": np.array([f"p-{i}é" for i in range(n)])}
    (np.savez_compressed if compressed else np.savez)(path, **arrays)
    return arrays


def records(path, arrays, **change):
    rows = [{"parameter_id": str(p), "label": int(l), "split": ("train", "val", "test")[i % 3]} for i, (p, l) in enumerate(zip(arrays["parameter_ids"], arrays["labels"]))]
    path.write_text(json.dumps({"records": change.get("rows", rows)}, indent=1))
    return rows


@pytest.mark.parametrize("compressed", [False, True])
def test_reads_what_numpy_wrote(spark, tmp_path, compressed):
    want = write(tmp_path / "states.npz", compressed=compressed)
    df = npz.read_npz(spark, f"{tmp_path}/states.npz", range_bytes=30 * (8 * 16 + 1 + 4 * 6))
    assert df.rdd.getNumPartitions() == (1 if compressed else 4)
    assert dict(df.dtypes) == {"archive": "string", "pos": "bigint", "states": "struct<re:array<double>,im:array<double>>", "labels": "bigint", "parameter_ids": "string"}
    rows = sorted(df.collect(), key=lambda r: r.pos)
    assert [r.pos for r in rows] == list(range(100)) and [r.parameter_ids for r in rows] == want["parameter_ids"].tolist() and [r.labels for r in rows] == want["labels"].tolist()
    assert np.array_equal(np.array([r.states.re for r in rows]) + 1j * np.array([r.states.im for r in rows]), want["states"])
    assert {r.labels for r in df.select("labels").where("pos = 7").collect()} == {1}


def test_filters_drop_ranges(spark, tmp_path):
    write(tmp_path / "states.npz")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = npz.read_npz(spark, f"{tmp_path}/states.npz", range_bytes=1530).where("pos >= 35 and pos < 52")
        assert sorted(r.pos for r in df.select("pos").collect()) == list(range(35, 52)) and df.rdd.getNumPartitions() == 2
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_manifest_decides(spark, tmp_path):
    arrays = write(tmp_path / "states.npz", 30)
    rows = records(tmp_path / "m.json", arrays)
    every = npz.read_npz_states(spark, f"{tmp_path}/states.npz", f"{tmp_path}/m.json").collect()
    assert len(every) == 30 and {(r.parameter_id, r.split, r.place) for r in every} == {(x["parameter_id"], x["split"], i) for i, x in enumerate(rows)}
    val = npz.read_npz_states(spark, f"{tmp_path}/states.npz", f"{tmp_path}/m.json", "val").collect()
    assert {r.place for r in val} == set(range(1, 30, 3)) and all(len(r.state.re) == 8 for r in val)
    for bad in (rows[:-1], rows + rows[:1], [rows[0] | {"label": 1}] + rows[1:], [rows[0] | {"split": "dev"}] + rows[1:]):
        records(tmp_path / "bad.json", arrays, rows=bad)
        with pytest.raises(Exception):
            npz.read_npz_states(spark, f"{tmp_path}/states.npz", f"{tmp_path}/bad.json").collect()


def test_round_trip_and_a_wrong_byte(spark, sf, tmp_path):
    df = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "label", "embedding").where("label is not null")
    npz.write_npz(df.repartition(3), f"{tmp_path}/out")
    back = npz.read_npz(spark, f"{tmp_path}/out")
    assert back.rdd.getNumPartitions() == 3 and npz.read_npz(spark, f"{tmp_path}/out", verify="false", range_bytes=20_000).rdd.getNumPartitions() > 3
    assert sorted((r.vec_id, r.label, list(r.embedding)) for r in back.collect()) == sorted((r.vec_id, r.label, list(r.embedding)) for r in df.collect())
    (tmp_path / "out" / "part-left.npz").write_bytes(b"left by a task that failed")
    assert back.count() == df.count()
    path = sorted(p for p in (tmp_path / "out").glob("part-*.npz") if p.name != "part-left.npz")[0]
    data = bytearray(path.read_bytes())
    data[len(data) // 2] ^= 1
    path.write_bytes(bytes(data))
    with pytest.raises(Exception, match="expected digest"):
        npz.read_npz(spark, f"{tmp_path}/out").collect()


def test_what_is_no_table_raises(spark, tmp_path):
    np.savez(tmp_path / "a.npz", x=np.zeros(3), y=np.zeros(4))
    np.savez(tmp_path / "b.npz", x=np.zeros((2, 2, 2)))
    (tmp_path / "none").mkdir()
    for name in ("a.npz", "b.npz", "none"):
        with pytest.raises(Exception):
            npz.read_npz(spark, f"{tmp_path}/{name}").collect()
    np.savez(tmp_path / "empty.npz", x=np.zeros(0))
    assert npz.read_npz(spark, f"{tmp_path}/empty.npz").count() == 0
    with pytest.raises(Exception, match="null"):
        npz.write_npz(spark.createDataFrame([(None,), (1,)], "x int").coalesce(1), f"{tmp_path}/n")
