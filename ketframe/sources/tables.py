"""Reading, writing and checking state tables and artifacts."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_state_table(df: DataFrame, path: str) -> None:
    """Parquet by split, written beside and then renamed, so a reader never sees half a table."""
    staged = f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}"
    df.write.partitionBy("split").parquet(staged)
    publish(df.sparkSession, staged, path)


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of the JVM."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def publish(spark: SparkSession, staged: str, path: str) -> None:
    """Rename a staged folder; never over an existing one."""
    fs, target = hadoop_path(spark, path)
    if fs.exists(target):
        raise FileExistsError(path)
    if not fs.rename(hadoop_path(spark, staged)[1], target):
        raise OSError(f"could not rename {staged} to {path}")


def read_states(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """A state table; a split prunes the scan to its folder."""
    df = spark.read.parquet(path)
    return df.where(F.col("split") == split) if split else df


def join_manifest(states: DataFrame, manifest: DataFrame, key: str = "parameter_id") -> DataFrame:
    """States joined one to one to a manifest (key, label, split, pos); its label, split and order win.

    Missing, repeated or contradicting keys fail the job where the row is read.
    """
    once = lambda df: df.withColumn("__n", F.count("*").over(_by(key)))
    a = once(states.withColumnsRenamed({c: f"__s_{c}" for c in states.columns if c != key}))
    b = once(manifest)
    j = a.withColumnRenamed("__n", "__na").join(b.withColumnRenamed("__n", "__nb"), key, "full_outer")
    told = lambda text: F.raise_error(F.concat(F.lit(f"{text}: "), F.coalesce(F.col(key), F.lit("null"))))
    label_differs = F.col("__s_label") != F.col("label") if "label" in states.columns else F.lit(False)
    sound = (
        F.when(F.col("__na").isNull() | F.col("__nb").isNull(), told("only on one side"))
        .when((F.col("__na") > 1) | (F.col("__nb") > 1), told("repeated"))
        .when(label_differs, told("labels differ"))
        .when(~F.col("split").isin("train", "val", "test"), told("unknown split"))
        .otherwise(F.lit("").cast("string"))
    )
    keep = [F.col(f"__s_{c}").alias(c) for c in states.columns if c not in manifest.columns]
    return j.where(sound == "").select(*manifest.columns, *keep)


def _by(key: str):
    from pyspark.sql import Window as W

    return W.partitionBy(key)


def manifest_audit(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: keys of both sides, repeated keys, and keys that the other side lacks."""
    a = left.groupBy(key).agg(F.count("*").alias("na"))
    b = right.groupBy(key).agg(F.count("*").alias("nb"))
    n = lambda c, name: F.count_if(c).alias(name)
    return a.join(b, key, "full_outer").agg(
        n(F.col("na").isNotNull(), "left_keys"), n(F.col("nb").isNotNull(), "right_keys"), n(F.col("na") > 1, "left_repeated"), n(F.col("nb") > 1, "right_repeated"),
        n(F.col("na").isNotNull() & F.col("nb").isNull(), "only_left"), n(F.col("na").isNull() & F.col("nb").isNotNull(), "only_right"),
    )


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(file, sha256, size) of every file under a folder, by name within it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    _, folder = hadoop_path(spark, path)
    root = folder.toUri().getPath().rstrip("/")
    full = F.regexp_replace("path", r"^\w+:/*", "/")
    inner = F.regexp_replace(full, "^.*?" + re.escape(root) + "/", "")
    return files.select(inner.alias("file"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"))


def compare_checksums(found: DataFrame, expected: DataFrame) -> DataFrame:
    """(file, status): ok, changed, missing or extra."""
    a, b = found.select("file", F.col("sha256").alias("f")), expected.select("file", F.col("sha256").alias("e"))
    status = F.when(F.col("f").isNull(), "missing").when(F.col("e").isNull(), "extra").when(F.col("f") == F.col("e"), "ok").otherwise("changed")
    return a.join(b, "file", "full_outer").select("file", status.alias("status"))


def changed_evidence(found: DataFrame, pinned: DataFrame) -> DataFrame:
    """Pinned files that are changed or missing; files that the pinned list lacks do not count."""
    return compare_checksums(found, pinned).where(F.col("status").isin("changed", "missing"))


def reproducibility_record(spark: SparkSession, config: dict, sources: str, datasets: dict[str, str]) -> DataFrame:
    """(kind, name, value): digests of a config, of the source files under a folder and of data folders, and versions."""
    import platform

    import numpy as np
    import pyarrow as pa

    from ketframe.functions.seeds import canonical_json

    digest = F.sha2(F.lit(canonical_json(config)).cast("binary"), 256)
    versions = {"python": platform.python_version(), "numpy": np.__version__, "pyarrow": pa.__version__, "spark": spark.version}
    out = spark.createDataFrame([("version", k, v) for k, v in versions.items()], "kind string, name string, value string")
    out = out.unionByName(spark.range(1).select(F.lit("config").alias("kind"), F.lit("config").alias("name"), digest.alias("value")))
    out = out.unionByName(checksums(spark, sources).select(F.lit("source").alias("kind"), F.col("file").alias("name"), F.col("sha256").alias("value")))
    for name, path in datasets.items():
        out = out.unionByName(tree_hash(checksums(spark, path)).select(F.lit("dataset").alias("kind"), F.lit(name).alias("name"), F.col("tree").alias("value")))
    return out


def tree_hash(files: DataFrame) -> DataFrame:
    """One row: a digest over (file, sha256) in the order of names."""
    row = F.concat_ws(" ", "file", "sha256")
    return files.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(row)), "\n").cast("binary"), 256).alias("tree"))


def union_rows(frames: list[DataFrame]) -> DataFrame:
    """Rows of several shapes under the union of their columns, in the order first seen."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", "true").csv(path)


def write_json_report(spark: SparkSession, value: dict, path: str) -> None:
    """A small report as sorted JSON; values that are not finite raise."""
    text = json.dumps(value, sort_keys=True, indent=2, allow_nan=False)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)


def write_markdown(spark: SparkSession, df: DataFrame, title: str, path: str, most: int = 1_000) -> None:
    """A report table of the first `most` rows, with the number of those left out."""
    rows = df.limit(most + 1).collect()
    more = df.count() - most if len(rows) > most else 0
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    lines += ["| " + " | ".join("" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) + " |" for r in rows[:most]]
    lines += ["", f"{more} more rows are not shown."] if more else []
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.text(path)
