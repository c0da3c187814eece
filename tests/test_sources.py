import random
import threading

import pytest
from pyspark.sql import functions as F

from ketframe.sources import json_tree, snapshots


def test_scalars_at_any_depth(spark):
    texts = ['{"a": 1, "b": {"a": [1, {"a": null}], "c": {"a": "x\\"y"}}, "d": []}', "[[{\"a\": true}], {}, 3]", "7", "", None, "{broken", '{"a": 1, "a": 2}', '{"é.x": {"a": 2.5}}', '{"a": 1} {"a": 2}', '{"a": 1}], [{"a": 2}', '{"a": 1}, "w": 3', ' {"b": [{"a": 4}]} \n']
    df = spark.createDataFrame(list(enumerate(texts)), "key int, json string").withColumn("pos", F.lit("p"))
    got = sorted((r["key"], r.path, r.name, r.value) for r in json_tree.scalars(df, "json", ["a"]).collect())
    assert got == [(0, "$.a", "a", "1"), (0, "$.b.a[1].a", "a", "null"), (0, "$.b.c.a", "a", '"x\\"y"'), (1, "$[0][0].a", "a", "true"), (7, "$.é.x.a", "a", "2.5"), (11, "$.b[0].a", "a", "4")]
    assert sorted(r["key"] for r in json_tree.unparsed(df, "json").collect()) == [3, 5, 6, 8, 9, 10]
    assert json_tree.scalars(df.limit(0), "json").collect() == []
    deep = spark.createDataFrame([("[" * 30 + '{"a": 1}' + "]" * 30,)], "json string")
    assert json_tree.scalars(deep, "json").first().path == "$" + "[0]" * 30 + ".a"


def test_files_and_their_bad_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text('{\n "g": 1,\n "x": {"g": 2}\n}')
    (tmp_path / "b.jsonl").write_text('{"g": 3}\nbroken\n\n{"g": 4}')
    (tmp_path / "c.json").write_text('{"g": 5}\n{"g": ')
    got = json_tree.harvest_json(spark, str(tmp_path), ["g"]).collect()
    assert sorted((r.file[-7:].lstrip("/"), r.value) for r in got) == sorted([("/a.json"[-7:].lstrip("/"), "1"), ("a.json", "2"), ("b.jsonl", "3"), ("b.jsonl", "4"), ("c.json", "5")])
    assert sorted((r.lines, r.bad_lines) for r in json_tree.unread_lines(spark, str(tmp_path)).collect()) == [(1, 0), (2, 1), (3, 1)]


def table(spark, rows):
    return spark.createDataFrame(rows, "k int, v string, w array<double>")


def test_trees_and_changed_rows(spark):
    rng = random.Random(4)
    rows = [(rng.choice([1, 2, None]) if i % 3 else i, rng.choice(["", "x", None, "1:n;"]), rng.choice([None, [], [0.5]])) for i in range(700)] + [(9, "hot", [1.0])] * 500
    a = table(spark, rows)
    root = lambda df: {r.node: r.digest for r in snapshots.digest_tree(df, 2).where("level = 0").collect()}
    assert root(a) == root(table(spark, rng.sample(rows, len(rows))).repartition(9).select("w", "k", "v"))
    tree = snapshots.digest_tree(a, 2).collect()
    assert all(sum(r.n for r in tree if r.level == d) == 1200 for d in range(3))
    other = rows[:300] + rows[301:-2] + [(1, "n", None)]
    from collections import Counter

    count = lambda rows: Counter((k, v, None if w is None else tuple(w)) for k, v, w in rows)
    for depth in (0, 1, 3):
        got = {(r.change, r.k, r.v, None if r.w is None else tuple(r.w)): r.copies for r in snapshots.changed_rows(a, table(spark, other), depth).collect()}
        lost, new = count(rows) - count(other), count(other) - count(rows)
        assert got == {("removed", *k): n for k, n in lost.items()} | {("added", *k): n for k, n in new.items()}
    assert root(a.limit(0)) == {} and snapshots.changed_rows(a, a.limit(0), 1).count() == len(count(rows))
    assert [snapshots.depth_of(n) for n in (0, 256, 257, 4096, 4097, 10**12)] == [0, 0, 1, 1, 2, 8]


def test_freeze_replay_and_a_second_writer(spark, tmp_path):
    root = f"{tmp_path}/log"
    make = lambda n: lambda: spark.range(n).select(F.col("id").cast("int").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"), F.array(F.rand(7) * 0).alias("w"))
    assert snapshots.freeze(spark, make(1000), root, note="first") == 1
    assert snapshots.freeze(spark, make(1003), root) == 2 and snapshots.versions(spark, root) == [1, 2]
    assert snapshots.replay(spark, root, 1).count() == 1000 and snapshots.replay(spark, root).count() == 1003
    assert sorted(r.k for r in snapshots.between(spark, root, 1, 2).where("change = 'added'").collect()) == [1000, 1001, 1002]
    folders = lambda: sorted(p.name for p in (tmp_path / "log" / "data").iterdir() if not p.name.startswith("."))
    before = folders()
    with pytest.raises(FileExistsError):
        snapshots.freeze(spark, make(5), root, parent=1)
    runs = iter([3, 4])
    with pytest.raises(snapshots.NotReproducedError, match="1 rows"):
        snapshots.freeze(spark, lambda: make(next(runs))(), root)
    assert folders() == before and snapshots.versions(spark, root) == [1, 2]
    with pytest.raises(FileNotFoundError):
        snapshots.replay(spark, root, 7)
    record = snapshots.record_of(spark, root, 1)
    make(999)().write.mode("append").parquet(f"{root}/{record['data']}")
    with pytest.raises(ValueError, match="other rows"):
        snapshots.replay(spark, root, 1)


def test_two_writers_at_once(spark, tmp_path):
    root, done = f"{tmp_path}/log", []

    def write(n):
        try:
            done.append(snapshots.freeze(spark, lambda: spark.range(n), root, parent=0))
        except FileExistsError:
            done.append(None)

    threads = [threading.Thread(target=write, args=(n,)) for n in (10, 20)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert snapshots.versions(spark, root) == [1] and 1 in done and len(done) == 2
    assert snapshots.replay(spark, root).count() in (10, 20)
