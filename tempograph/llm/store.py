"""Places that every executor can read, for tables that cut lineage."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where none is set, as in tests, a folder of this machine, but on a cluster an error."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        known = tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", known)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(known)
    return known


#: Bytes of rows that go to a Python worker, or come from it, at once.
BATCH_BYTES = 4 << 20
MOST = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by bytes, as rows of long texts or sets fill an executor long before their number counts."""
    if not 0 < int(spark.conf.get(MOST).removesuffix("b")) <= BATCH_BYTES:
        spark.conf.set(MOST, BATCH_BYTES)


def table(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Writes df to a folder, the shared one by default, and reads it back, so a lost executor costs no recomputation of its lineage."""
    spark = df.sparkSession
    path = f"{(folder or checkpoint_dir(spark)).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.shared_path = path
    # lets Spark's cleaner drop the shuffle files of plans that nothing refers to any more
    del df
    gc.collect()
    spark._jvm.System.gc()
    return out


def drop(table: DataFrame) -> None:
    """Deletes a table written by `table` that nothing reads any more."""
    spark = table.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(table.shared_path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
