"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and returns a frame; `run` writes each one's rows to the
shared folder and gives them to the next. All but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ketframe.llm import decontaminate, line_dedup, quality_rules, sentencepiece, simhash
from ketframe.llm._common import documents, materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, with limits that a junk source cannot raise.

    A null text counts as empty and goes, as does every text under the base rules; rows that agree stay or go together.
    """
    return quality_rules.drop_rejected(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines it shares with an earlier one; n_chars follows.

    A null text stays null, with a null n_chars; a text that loses all its lines is empty; rows that agree lose the same.
    """
    out = line_dedup.dedup_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, a similarity of 0.8 or more.

    Texts without words, null among them, are one group; of rows that agree one stays; null ids come last.
    """
    return simhash.keep_one_of_each(docs, simhash.similar_documents(docs))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item contaminates.

    A null text or one without words is clean; so is every document where there are no items.
    """
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, and whether they decode to its text.

    A null or empty text has no ids and decodes to the empty text.
    """
    import public_tokenizers

    out = sentencepiece.sentencepiece_round_trip(docs, public_tokenizers.path("piece_bpe_32k.model"))
    whole = F.col("decoded") == F.coalesce("text", F.lit(""))
    return out.select("doc_id", "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_tokens"), "ids", whole.alias("round_trip"))


STAGES = [("quality rules", quality), ("line dedup", lines), ("near-dedup", near_duplicates), ("decontamination", benchmark), ("tokens", tokens)]

#: SQL has neither the hashes nor the tokenizer of these stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
