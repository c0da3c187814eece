"""Chat formatting with cumulative-snapshot collapse.

Chat services often log a conversation anew after every turn, so a log holds many conversations
that are only the beginning of a longer one. Each turn is reduced to a digest; a rolling digest
over them in turn order stands for each prefix of a conversation. A conversation goes if its last
rolling digest is a prefix of a longer conversation, or belongs to an equal one with a smaller id;
only the others (maximal conversations) are rendered.

What is compared are digests of 16 bytes a turn; texts are shuffled once, to be rendered, and only
those of maximal conversations. Prefix digests are made distinct before they are joined, with
partial aggregation, so a conversation or first turn that very many share is one row from each task.

Defined cases: turns are ordered by turn number (nulls first), then digest; a null role or
text differs from an empty one in comparisons and is rendered as empty; a turn without a conversation
id is a conversation of its own; repeated rows of a turn count once each; columns besides the four named are left
behind, since a conversation has no single value for them.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ketframe.llm._common import bounded_batches, materialize

START, END = "<|im_start|>", "<|im_end|>"


def _told(c: Column) -> Column:
    """A text that tells null from empty, with its length first so that parts can be put in a row."""
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.length(c).cast("string"), F.lit(":"), c))


def _rolling():
    @F.arrow_udf("array<binary>")
    def rolling(digests: pa.Array) -> pa.Array:
        rows = []
        for turns in digests.to_pylist():
            last, out = b"", []
            for d in turns:
                last = hashlib.md5(last + d.encode()).digest()
                out.append(last)
            rows.append(out)
        return pa.array(rows, pa.list_(pa.binary()))

    return rolling


def _turns(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """k, conv, turn, role, text, digest and copies; turns of no conversation that agree are one row."""
    rows = df.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("digest", F.md5(F.concat(_told(F.col("role")), _told(F.col("text"))).cast("binary")))
    rows = rows.withColumn("k", F.when(F.col("conv").isNull(), F.concat(F.lit("-"), "digest")).otherwise(F.concat(F.lit("i"), F.col("conv").cast("string"))))
    alone = rows.where("conv is null").groupBy("k", "digest").agg(F.first("conv").alias("conv"), F.min("turn").alias("turn"), F.first("role").alias("role"), F.first("text").alias("text"), F.count("*").alias("copies"))
    return rows.where("conv is not null").withColumn("copies", F.lit(1).cast("long")).unionByName(alone)


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """(k, n, copies) of conversations that are no prefix of another; copies counts the equal ones. turns: k, conv, turn, digest, copies.

    k is the id as text that is never null, so that one shuffle by it serves the join and the grouping.
    """
    convs = turns.groupBy("k").agg(F.max("conv").alias("conv"), F.max("copies").alias("copies"), F.array_sort(F.collect_list(F.struct("turn", "digest"))).alias("t"))
    convs = materialize(convs.select("k", "conv", "copies", F.size("t").alias("n"), _rolling()(F.transform("t", lambda x: x["digest"])).alias("rolling")), "prefixes")
    inner = convs.where("n > 1").select(F.explode(F.slice("rolling", F.lit(1), F.col("n") - 1)).alias("whole")).distinct()
    whole = convs.select("k", "conv", "n", "copies", F.element_at("rolling", -1).alias("whole"))
    first = F.min(F.struct(F.col("conv").isNull().alias("last"), "conv", "k", "n")).alias("first")
    equal = whole.groupBy("whole").agg(first, F.sum("copies").alias("copies"))
    return equal.join(inner, "whole", "left_anti").select("first.k", "first.n", "copies")


def render(turns: Column) -> Column:
    """ChatML of an array of turns (role, text); its markers inside a role or text lose their bars."""
    clean = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit(START), F.lit(START.replace("|", ""))), F.lit(END), F.lit(END.replace("|", "")))
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(START), clean(t["role"]), F.lit("\n"), clean(t["text"]), F.lit(END + "\n"))), "")


def format_chats(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", out_col: str = "rendered") -> DataFrame:
    """(conv_col, n_turns, n_copies, out_col): maximal conversations, rendered."""
    bounded_batches(df.sparkSession)
    turns = _turns(df, conv_col, turn_col, role_col, text_col)
    kept = maximal_conversations(turns.select("k", "conv", "turn", "digest", "copies"))
    out = turns.drop("copies").join(kept, "k").groupBy("k").agg(F.max("conv").alias("conv"), F.first("n").cast("long").alias("n_turns"), F.first("copies").alias("n_copies"), F.array_sort(F.collect_list(F.struct("turn", "digest", "role", "text"))).alias("t"))
    return out.select(F.col("conv").alias(conv_col), "n_turns", "n_copies", render(F.col("t")).alias(out_col))


def op6(spark, sf_dir: str) -> DataFrame:
    """Query: every maximal conversation, rendered."""
    return format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP6_SQL = """
WITH a AS (SELECT conv_id, turn, role, text, md5(CASE WHEN role IS NULL THEN '-' ELSE length(role) || ':' || role END || CASE WHEN text IS NULL THEN '-' ELSE length(text) || ':' || text END) AS d FROM conversations),
t AS (SELECT 'i' || conv_id AS k, conv_id, turn, role, text, d, 1 AS copies FROM a WHERE conv_id IS NOT NULL
      UNION ALL SELECT '-' || d, any_value(conv_id), min(turn), any_value(role), any_value(text), d, count(*) FROM a WHERE conv_id IS NULL GROUP BY d),
c AS (SELECT k, max(conv_id) AS conv_id, max(copies) AS copies, list(d ORDER BY turn NULLS FIRST, d) AS ds,
        string_agg('<|im_start|>' || replace(replace(coalesce(role, ''), '<|im_start|>', '<im_start>'), '<|im_end|>', '<im_end>') || chr(10)
          || replace(replace(coalesce(text, ''), '<|im_start|>', '<im_start>'), '<|im_end|>', '<im_end>') || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS FIRST, d) AS rendered
      FROM t GROUP BY k),
inner_ AS (SELECT DISTINCT ds[1:n] AS ds FROM (SELECT ds, unnest(generate_series(1, len(ds) - 1)) AS n FROM c)),
e AS (SELECT ds, first(k ORDER BY conv_id NULLS LAST, k) AS k, sum(copies) AS n_copies FROM c GROUP BY ds)
SELECT conv_id, CAST(len(c.ds) AS BIGINT) AS n_turns, CAST(n_copies AS BIGINT) AS n_copies, rendered FROM e JOIN c USING (k) WHERE e.ds NOT IN (SELECT ds FROM inner_)
"""
