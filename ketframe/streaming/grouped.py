"""Grouped statistics over a stream, with the same columns as the batch query in each window.

State is one small buffer a group and open window; a window is closed, and its state dropped, when
the watermark passes its end. Late rows behind the watermark are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ketframe.functions.columns import finite


def windowed_stats(rows: DataFrame, time_col: str, group_col: str, value_col: str, window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """(start, group, n, mean, std, min, max) of finite values by tumbling window; works on a stream and on a table."""
    x = F.when(finite(F.col(value_col)), F.col(value_col))
    rows = rows.withColumn(time_col, F.col(time_col).cast("timestamp"))
    grouped = rows.withWatermark(time_col, delay).groupBy(F.window(time_col, window).alias("w"), F.col(group_col).alias("group"))
    stats = grouped.agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))
    return stats.select(F.col("w.start").alias("start"), "group", "n", "mean", "std", "min", "max")


def read_stream(spark: SparkSession, path: str, like: DataFrame, files_at_once: int = 1) -> DataFrame:
    """New Parquet files of a folder as a stream, with the schema of a table."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def write_windows(stats: DataFrame, path: str, checkpoint: str):
    """Append closed windows to a Parquet folder, exactly once, from all files that are there now."""
    return stats.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start()
