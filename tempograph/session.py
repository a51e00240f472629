"""Session factory and table loader."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(cpus: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings that the queries assume; on a cluster pass your own session instead."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("tempograph")
    settings = {
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "12g",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df in at least as many partitions as there are cores; a table of many files is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession, kind: str) -> str:
    """A new folder in the session's spark.checkpoint.dir; where none is set, as in tests, on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix=f"{kind}-")
    return f"{root.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back, so that plans which read it several times stay small."""
    path = shared_dir(df.sparkSession, "kept")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
