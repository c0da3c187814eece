"""Model checkpoints as one-row tables, verified reads, and corpora of several shapes."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT = "parameters array<array<array<double>>>, angles map<int, double>, n_data int, n_ancilla int"


def write_checkpoint(spark: SparkSession, path: str, parameters: np.ndarray, angles: dict[int, float], n_data: int | None = None, n_ancilla: int | None = None) -> None:
    row = (np.asarray(parameters).tolist(), {int(k): float(v) for k, v in angles.items()}, n_data, n_ancilla)
    spark.createDataFrame([row], CHECKPOINT).coalesce(1).write.parquet(path)


def read_checkpoint(spark: SparkSession, path: str) -> dict:
    """A checkpoint; older ones without sizes get them from the width of a layer and one ancilla."""
    r = spark.read.schema(CHECKPOINT).parquet(path).first()
    parameters = np.array(r.parameters)
    ancilla = r.n_ancilla if r.n_ancilla is not None else 1
    data = r.n_data if r.n_data is not None else (parameters.shape[-1] + 3) // 5 - ancilla
    return {"parameters": parameters, "angles": dict(r.angles), "n_data": data, "n_ancilla": ancilla}


def verified_bytes(spark: SparkSession, path: str, sha256: str) -> bytes:
    """A small file's bytes, refused unless they have the expected digest; what is checked is what is returned."""
    data = bytes(spark.read.format("binaryFile").load(path).select("content").first().content)
    if hashlib.sha256(data).hexdigest() != sha256:
        raise ValueError(f"{path} does not have the expected digest")
    return data


def normalised_records(frames: dict[str, DataFrame]) -> DataFrame:
    """Corpora of several shapes as one table with `corpus`; the blocked regime's three spellings become one."""
    from ketframe.sources.tables import union_rows

    out = union_rows([f.withColumn("corpus", F.lit(n)) for n, f in frames.items()])
    if "regime" in out.columns:
        out = out.withColumn("regime", F.when(F.col("regime").isin("blocked", "blocked-g", "blocked_g"), "blocked_g").otherwise(F.col("regime")))
    return out
