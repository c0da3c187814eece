"""Small helpers the training-data operators share."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch. Long texts make batches large, and each executor
#: core holds one batch on both sides of the socket, so the default of 10,000
#: is too many for documents.
ARROW_ROWS = 512

#: ASCII white space, the separators of words.
SPACE = r"[\x20\x09-\x0D]+"


def bounded_batches(spark: SparkSession) -> None:
    """Hold Arrow batches at ARROW_ROWS rows, or fewer where the session asks for fewer."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        found = tempfile.mkdtemp(prefix="ketframe-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str, packed: bool = False) -> DataFrame:
    """Write df to the shared folder as Parquet and read it back: short lineage that survives lost executors.

    packed: rows much narrower than those they were made from are dealt out anew, so that the files
    are few and of the size adaptive execution aims at, not a small one for each split of the input.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    (df.hint("rebalance") if packed else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Delete the files behind frames that materialize() returned, once nothing reads them any more.

    The driver collects garbage too, upon which Spark drops the broadcast tables and shuffles of frames that are
    gone; executors would keep them otherwise until the driver runs short of memory.
    """
    for df in tables:
        spark = df.sparkSession
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = hadoop.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    if tables:
        gc.collect()
        tables[0].sparkSession.sparkContext._jvm.System.gc()


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: Column) -> Column:
    """Words of a text: maximal runs of other than ASCII white space; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def row_key(doc_id: Column, text: Column) -> Column:
    """16 bytes that stand for a row's id and text; rows that agree in both are one document."""
    told = lambda c, mark: F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.lit(mark), c.cast("string")))
    return F.unhex(F.md5(F.concat(told(doc_id, "i"), F.lit("\x1f"), told(text, "t")).cast("binary")))


#: Keys of 16 bytes that are broadcast at once, about 50 MB in memory.
BROADCAST_KEYS = 500_000


def without_keys(df: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """The rows of df whose key is not in gone (one column of that name, materialized).

    Up to BROADCAST_KEYS keys are broadcast, and df stays where it is; more are joined by a shuffle.
    """
    return df.join(F.broadcast(gone) if gone.count() <= BROADCAST_KEYS else gone, key, "left_anti")
