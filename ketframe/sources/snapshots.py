"""Tables frozen as snapshots: made twice, compared by a tree of digests, committed in a log, replayed and checked.

A tree has the digests of distinct rows, with how often each occurs, in leaves by the first hex digits of the row's
digest; a node's digest is that of its at most sixteen children. So a leaf's size does not depend on any key, equal rows
are counted before they meet, and two tables are compared from the root down: only children of nodes that differ are
looked at, and only rows of differing leaves are joined.

A snapshot is a folder of Parquet beside its tree, both written before the record in the log that names them. A
record is written aside and renamed without overwriting; of two writers of the same version one gets FileExistsError
and what it staged is removed. The rename is atomic where the store's is (HDFS); on object stores put the log elsewhere.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ketframe.operators.rounds import cut
from ketframe.sources.tables import hadoop_path

LEAF_ROWS = 256
DEEPEST = 8


class NotReproducedError(ValueError):
    """A second run of a table has other rows."""


def row_text(df: DataFrame) -> Column:
    """A row's values in order of column names, each with its length, null as such; so different rows have different texts."""

    def told(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        text = F.to_json(F.struct(c)) if kind.startswith(("array", "struct", "map")) else F.base64(c) if kind == "binary" else c.cast("string")
        return F.when(c.isNull(), F.lit("n;")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text, F.lit(";")))

    return F.concat(*(told(name, kind) for name, kind in sorted(df.dtypes)))


def row_digests(df: DataFrame) -> DataFrame:
    """(row, copies) of distinct rows."""
    return df.select(F.sha2(row_text(df).cast("binary"), 256).alias("row")).groupBy("row").agg(F.count("*").alias("copies"))


def depth_of(rows: int) -> int:
    """Levels below the root with which a leaf has LEAF_ROWS rows or fewer on average."""
    return next((d for d in range(DEEPEST) if 16**d * LEAF_ROWS >= rows), DEEPEST)


def digest_tree(df: DataFrame, depth: int) -> DataFrame:
    """(level, node, n, digest): level 0 is the root with node ''; n counts rows. An empty table has no node."""
    row = F.concat_ws("*", "row", F.col("copies").cast("string"))
    leaf = F.substring("row", 1, depth) if depth else F.lit("")
    joined = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), ",").cast("binary"), 256).alias("digest")
    level = cut(row_digests(df).groupBy(leaf.alias("node")).agg(F.sum("copies").alias("n"), joined(row)))
    out = level.select(F.lit(depth).alias("level"), "node", "n", "digest")
    for d in range(depth - 1, -1, -1):
        up = F.substring("node", 1, d) if d else F.lit("")
        level = level.groupBy(up.alias("node")).agg(F.sum("n").alias("n"), joined(F.concat_ws(":", "node", "digest")))
        out = out.unionByName(level.select(F.lit(d).alias("level"), "node", "n", "digest"))
    return out


def differing_leaves(a: DataFrame, b: DataFrame, depth: int) -> DataFrame:
    """Nodes of the deepest level that differ between two trees of the same depth, found from the root down."""
    nodes = None
    for d in range(depth + 1):
        at = lambda t: t.where(F.col("level") == d)  # noqa: E731, B023
        x, y = at(a), at(b)
        if nodes is not None:
            parents = nodes.withColumnRenamed("node", "parent")
            x, y = (t.join(parents, F.substring("node", 1, d - 1) == F.col("parent") if d > 1 else F.col("parent") == "", "left_semi") for t in (x, y))
        both = x.select("node", F.col("digest").alias("x")).join(y.select("node", F.col("digest").alias("y")), "node", "full_outer")
        nodes = both.where(~F.col("x").eqNullSafe(F.col("y"))).select("node")
    return nodes


def changed_rows(a: DataFrame, b: DataFrame, depth: int, trees: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Rows of one table that the other has not, or has less often: (change, copies, a's columns), change being removed or added."""
    one, other = trees or (digest_tree(a, depth), digest_tree(b, depth))
    leaves = cut(differing_leaves(one, other, depth))

    def rows(df: DataFrame) -> DataFrame:
        told = df.select(F.struct(*a.columns).alias("values"), F.sha2(row_text(df).cast("binary"), 256).alias("row"))
        told = told.join(leaves, (F.substring("row", 1, depth) if depth else F.lit("")) == F.col("node"), "left_semi")
        return told.groupBy("row").agg(F.first("values").alias("values"), F.count("*").alias("copies"))

    x, y = rows(a), rows(b)
    both = x.select("row", F.col("values").alias("xv"), F.col("copies").alias("x")).join(y.select("row", F.col("values").alias("yv"), F.col("copies").alias("y")), "row", "full_outer")
    more = F.coalesce("x", F.lit(0)) - F.coalesce("y", F.lit(0))
    out = both.where(more != 0).select(F.when(more > 0, "removed").otherwise("added").alias("change"), F.abs(more).alias("copies"), F.coalesce("xv", "yv").alias("values"))
    return out.select("change", "copies", *(F.col("values")[c].alias(c) for c in a.columns))


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the committed snapshots, ascending; the log is a list of small files."""
    fs, log = hadoop_path(spark, f"{root}/_log")
    names = [f.getPath().getName() for f in fs.listStatus(log)] if fs.exists(log) else []
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith((".", "_")))


def record_of(spark: SparkSession, root: str, version: int | None = None) -> dict:
    """A committed record; the last one without a version."""
    known = versions(spark, root)
    if not known or version is not None and version not in known:
        raise FileNotFoundError(f"{root} has no snapshot {version if version is not None else ''}".rstrip())
    at = known[-1] if version is None else version
    return json.loads(spark.read.text(f"{root}/_log/{at:010d}.json", wholetext=True).first().value)


def freeze(spark: SparkSession, make: Callable[[], DataFrame], root: str, parent: int | None = None, note: str = "") -> int:
    """Write a table, make it anew, and commit it as the version after `parent` (after the last one without) if both have the same rows.

    Raises NotReproducedError with the number of differing rows, or FileExistsError if another writer has the version;
    either way nothing of this one stays.
    """
    before = parent if parent is not None else max(versions(spark, root), default=0)
    name = uuid.uuid4().hex
    data, tree = f"{root}/data/{name}", f"{root}/trees/{name}"
    try:
        make().write.parquet(data)
        written = spark.read.parquet(data)
        n = written.count()
        depth = depth_of(n)
        digest_tree(written, depth).write.parquet(tree)
        kept, again = spark.read.parquet(tree), make()
        second = cut(digest_tree(again, depth))
        if differing_leaves(kept, second, depth).count():
            raise NotReproducedError(f"{changed_rows(written, again, depth, (kept, second)).count()} rows differ in a second run")
        top = kept.where("level = 0").first()
        record = {"version": before + 1, "parent": before, "data": f"data/{name}", "tree": f"trees/{name}", "depth": depth, "rows": n, "digest": top.digest if top else "", "note": note}
        _commit(spark, root, before + 1, record)
    except BaseException:
        for path in (data, tree):
            fs, p = hadoop_path(spark, path)
            fs.delete(p, True)
        raise
    return before + 1


def _commit(spark: SparkSession, root: str, version: int, record: dict) -> None:
    jvm = spark.sparkContext._jvm
    fs, log = hadoop_path(spark, f"{root}/_log")
    fs.mkdirs(log)
    _, staged = hadoop_path(spark, f"{root}/_log/.{uuid.uuid4().hex}.staged")
    _, target = hadoop_path(spark, f"{root}/_log/{version:010d}.json")
    if fs.exists(target):
        raise FileExistsError(str(target))
    out = fs.create(staged, False)
    out.write(bytearray(json.dumps(record, sort_keys=True).encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(fs.makeQualified(staged), fs.makeQualified(target), none)
    except Exception as e:
        fs.delete(staged, False)
        if fs.exists(target):
            raise FileExistsError(str(target)) from e
        raise


def replay(spark: SparkSession, root: str, version: int | None = None, verify: bool = True) -> DataFrame:
    """A snapshot's table, refused unless its rows have the digest in its record."""
    record = record_of(spark, root, version)
    df = spark.read.parquet(f"{root}/{record['data']}")
    if verify:
        top = digest_tree(df, record["depth"]).where("level = 0").first()
        if (top.digest if top else "") != record["digest"]:
            raise ValueError(f"snapshot {record['version']} of {root} has other rows than were committed")
    return df


def between(spark: SparkSession, root: str, old: int, new: int) -> DataFrame:
    """Rows added and removed between two snapshots; stored trees are used where they have the same depth."""
    a, b = record_of(spark, root, old), record_of(spark, root, new)
    read = lambda r, what: spark.read.parquet(f"{root}/{r[what]}")
    same = a["depth"] == b["depth"]
    return changed_rows(read(a, "data"), read(b, "data"), max(a["depth"], b["depth"]), (read(a, "tree"), read(b, "tree")) if same else None)
