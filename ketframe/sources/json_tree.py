"""Scalars of nested JSON at any depth, taken apart level by level as VARIANT.

A level's nodes are exploded into their members, so each job handles one depth of all
documents, whatever their shape; there are as many jobs as the deepest text has levels. Large documents spread as their
members do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ketframe.operators.rounds import cut

NODE, PATH, NAME = "__node", "__path", "__name"


def whole_json(text: Column) -> Column:
    """A text as VARIANT; null unless all of it is one JSON value.

    The parser leaves what follows a value unread, so the text is parsed within an array and within an object: nothing can
    end both before their own ends.
    """
    listed, member = F.try_parse_json(F.concat(F.lit("["), text, F.lit("\n]"))), F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("\n}")))
    return F.when(member.isNotNull(), F.try_variant_get(listed, "$[0]", "variant"))


def scalars(df: DataFrame, json_col: str, names: list[str] | None = None) -> DataFrame:
    """(df's other columns, path, name, value): each scalar member of an object (of one of the names), value as JSON.

    Elements of arrays have no name and are not returned themselves; null texts and texts that are no JSON, among them
    objects that repeat a member, give no row: see `unparsed`.
    """
    keys = [c for c in df.columns if c != json_col]
    parsed = whole_json(F.col(json_col))
    level = cut(df.select(*keys, parsed.alias(NODE), F.lit("$").alias(PATH), F.lit(None).cast("string").alias(NAME)).where(F.col(NODE).isNotNull()))
    found = []
    while not level.isEmpty():
        members = df.sparkSession.tvf.variant_explode_outer(F.col(NODE).outer())
        opened = level.lateralJoin(members).withColumnsRenamed({"pos": "__pos", "key": "__key", "value": "__value"}) if not {"pos", "key", "value"} & set(keys) else _opened(level, keys)
        opened = cut(opened.withColumn("__leaf", F.col("__pos").isNull()))
        scalar = F.col("__leaf") & F.col(NAME).isNotNull() & ~F.schema_of_variant(NODE).rlike("^(OBJECT|ARRAY)")
        wanted = F.col(NAME).isin(names) if names is not None else F.lit(True)
        found.append(opened.where(scalar & wanted).select(*keys, F.col(PATH).alias("path"), F.col(NAME).alias("name"), F.to_json(NODE).alias("value")))
        step = F.coalesce(F.concat(F.lit("."), "__key"), F.concat(F.lit("["), "__pos", F.lit("]")))
        level = opened.where(~F.col("__leaf")).select(*keys, F.col("__value").alias(NODE), F.concat(PATH, step).alias(PATH), F.col("__key").alias(NAME))
    if not found:
        return df.select(*keys, *(F.lit("").alias(c) for c in ("path", "name", "value"))).where(F.lit(False))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _opened(level: DataFrame, keys: list[str]) -> DataFrame:
    """The same for rows with columns of the names that the members' have."""
    kept = level.select(F.struct(*keys).alias("__keys"), NODE, PATH, NAME)
    opened = kept.lateralJoin(level.sparkSession.tvf.variant_explode_outer(F.col(NODE).outer()))
    return opened.select(*(F.col("__keys")[k].alias(k) for k in keys), NODE, PATH, NAME, F.col("pos").alias("__pos"), F.col("key").alias("__key"), F.col("value").alias("__value"))


def unparsed(df: DataFrame, json_col: str) -> DataFrame:
    """The rows of df whose text is not null and no JSON."""
    return df.where(F.col(json_col).isNotNull() & whole_json(F.col(json_col)).isNull())


def json_texts(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, json) below a folder: a .json file as one text, or line by line where it is not one; .jsonl and others by lines, which are split among tasks."""
    read = spark.read.option("recursiveFileLookup", "true")
    file = F.col("_metadata.file_path").alias("file")
    whole = read.option("pathGlobFilter", "*.json").text(path, wholetext=True).select(file, F.col("value").alias("json"))
    one = whole_json(F.col("json")).isNotNull()
    lines = whole.select("file", F.posexplode(F.when(one, F.array("json")).otherwise(F.split("json", "\r\n|\n|\r"))).alias("line", "json"))
    rest = read.option("pathGlobFilter", "*.json?*").text(path).select(file, F.lit(None).cast("int").alias("line"), F.col("value").alias("json"))
    return lines.unionByName(rest).where(F.trim("json") != "")


def harvest_json(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """(file, line, path, name, value) of every scalar under one of the names, at any depth, in JSON and JSON-lines files below a folder."""
    return scalars(json_texts(spark, path), "json", names)


def unread_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, lines, bad_lines): how many texts each file has and how many of them are no JSON."""
    bad = whole_json(F.col("json")).isNull()
    return json_texts(spark, path).groupBy("file").agg(F.count("*").alias("lines"), F.count_if(bad).alias("bad_lines"))
