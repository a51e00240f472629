"""Streaming twins of ordered operators: state goes from batch to batch, so how input is cut changes nothing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tempograph.functions import stateful
from tempograph.session import shared_dir

METER = "user_id long, frames long, peak double, sum_sq double, pole double"


def files(spark: SparkSession, sf_dir: str, name: str, per_trigger: int = 1) -> DataFrame:
    """A table's files as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(f"{sf_dir}/{name}.parque[t]")


def drain(stream: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over all that is there and gives what it wrote, with the batch it was written in."""
    spark = stream.sparkSession
    out = shared_dir(spark, "stream")

    def write(batch: DataFrame, number: int) -> None:
        # a batch that is done again after a failure replaces what it wrote before
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/data/batch={number:09d}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    schema = stream.withColumn("batch", F.lit(0).cast("long")).schema
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{out}/data")


def hop_counts(events: DataFrame, width: str, slide: str | None, late: str, *keys: str) -> DataFrame:
    """Events and sum of values in windows of event time, hopping by `slide` or, without it, side by side.

    Rows later than `late` behind the watermark are dropped.
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width, slide).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.unix_timestamp("w.start").alias("start"), *keys, "n", "total")


def running_meter(signal: DataFrame, a: float) -> DataFrame:
    """Frames, peak, sum of squares and a one-pole filter of each user's x, carried from batch to batch.

    Rows of a batch are taken in order of (ts, event_id); files must come in
    order of time for the filter to be the batch operator's.
    """

    def step(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        frames, peak, sum_sq, y = state.get if state.exists else (0, 0.0, 0.0, 0.0)
        x = pd.concat(list(chunks)).sort_values(["ts", "event_id"])["x"].to_numpy()
        pole = stateful.Section((a, 0.0, 0.0), (1.0, a - 1.0, 0.0))
        pole.state[0] = (1.0 - a) * y
        y = float(pole.push(x)[-1])
        frames, peak, sum_sq = frames + len(x), max(peak, float(np.abs(x).max())), sum_sq + float((x * x).sum())
        state.update((frames, peak, sum_sq, y))
        yield pd.DataFrame([(key[0], frames, peak, sum_sq, y)], columns=["user_id", "frames", "peak", "sum_sq", "pole"])

    kept = "frames long, peak double, sum_sq double, pole double"
    return signal.groupBy("user_id").applyInPandasWithState(step, METER, kept, "update", GroupStateTimeout.NoTimeout)


LIMITED = "user_id long, start long, y array<double>, gain double, held array<double>"


def running_limiter(signal: DataFrame, ceiling: float, release: float, look: int, decimate: int) -> DataFrame:
    """Each batch's limited samples of a user from number `start` on, and what the limiter still holds: its gain and samples.

    Order is that of `running_meter`; `flushed` adds what is held at the end.
    """

    def step(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, gain, held = state.get if state.exists else (0, 1.0, [])
        limiter = stateful.Limiter(ceiling, release, look, decimate)
        limiter.gain, limiter.held = gain, np.array(held, float)
        y = limiter.push(pd.concat(list(chunks)).sort_values(["ts", "event_id"])["x"].to_numpy())
        state.update((start + len(y), limiter.gain, limiter.held.tolist()))
        yield pd.DataFrame([(key[0], start, y.tolist(), limiter.gain, limiter.held.tolist())], columns=["user_id", "start", "y", "gain", "held"])

    return signal.groupBy("user_id").applyInPandasWithState(step, LIMITED, "start long, gain double, held array<double>", "update", GroupStateTimeout.NoTimeout)


def flushed(found: DataFrame, ceiling: float, release: float, look: int, decimate: int) -> DataFrame:
    """(user_id, n, y) of all samples that `running_limiter` gave and those it held when the input ended."""

    def run(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in chunks:
            rows = []
            for user, start, gain, held in pdf.itertuples(index=False):
                limiter = stateful.Limiter(ceiling, release, look, decimate)
                limiter.gain, limiter.held = gain, np.array(held, float)
                rows.append((user, start, limiter.flush().tolist()))
            yield pd.DataFrame(rows, columns=["user_id", "start", "y"])

    last = found.groupBy("user_id").agg(F.max_by(F.struct((F.col("start") + F.size("y")).alias("start"), "gain", "held"), "batch").alias("l")).select("user_id", "l.*")
    every = found.select("user_id", "start", "y").unionByName(last.mapInPandas(run, "user_id long, start long, y array<double>"))
    return every.select("user_id", "start", F.posexplode("y").alias("i", "v")).select("user_id", (F.col("start") + F.col("i")).alias("n"), F.col("v").alias("y"))
