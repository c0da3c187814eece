"""The corpus pipeline; its stages are in ketframe/llm/pipeline.py.

    spark-submit corpus_pipeline.py INPUT OUTPUT
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from ketframe.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]

if __name__ == "__main__":
    run(SparkSession.builder.getOrCreate(), sys.argv[1]).write.parquet(sys.argv[2])
