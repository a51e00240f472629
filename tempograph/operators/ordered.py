"""Ordered signals: numbering, frames, chunks, and treatments that carry state."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def numbered(df: DataFrame, key: str, order: list[str], bucket: Column) -> DataFrame:
    """Adds n = 0, 1, ... of each key's rows in `order`.

    `bucket` must not fall as the order rises (a day of a timestamp, say).
    Rows are numbered within (key, bucket), and buckets are offset by the
    counts before them, so that a key with very many rows is spread over its
    buckets instead of being one task's sort.
    """
    df = df.withColumn("__b", bucket)
    counts = df.groupBy(key, "__b").agg(F.count("*").alias("__c"))
    offsets = counts.select(key, "__b", (F.sum("__c").over(W.partitionBy(key).orderBy("__b")) - F.col("__c")).alias("__o"))
    local = F.row_number().over(W.partitionBy(key, "__b").orderBy(*order)) - 1
    return df.withColumn("__n", local).join(offsets, [key, "__b"]).withColumn("n", F.col("__n") + F.col("__o")).drop("__b", "__c", "__o", "__n")


def framed(signal: DataFrame, key: str, win: int, hop: int, drop_last: bool = False) -> DataFrame:
    """One row for each sample and frame i*hop .. i*hop+win-1 that holds it; only complete frames.

    `drop_last` keeps (len - win) // hop frames, one less than there are.
    """
    size = signal.groupBy(key).agg(F.count("*").alias("__len"))
    return _spread(signal.join(size, key), F.col("n"), 1, win, hop, drop_last)


def _spread(rows: DataFrame, at: Column, step: int, win: int, hop: int, drop_last: bool) -> DataFrame:
    """Each row, a run of `step` samples from `at * step` on, once for each frame that holds it."""
    win, hop = win // step, hop // step
    frames = F.floor((F.floor(F.col("__len") / step) - win) / hop) + (0 if drop_last else 1)
    first = F.greatest(F.ceil((at - win + 1) / hop), F.lit(0))
    last = F.least(F.floor(at / hop), frames - 1)
    fits = (F.col("__len") >= win * step) & (first <= last)
    return rows.where(fits).withColumn("frame", F.explode(F.sequence(first, last))).drop("__len")


def frame_sums(signal: DataFrame, key: str, win: int, hop: int, drop_last: bool = False) -> DataFrame:
    """(key, frame, count, total, square, top): samples, sum, sum of squares and maximum of every complete frame.

    Runs as long as the greatest common divisor of win and hop are summed
    first, and only these are dealt to the frames that overlap them.
    """
    step = math.gcd(win, hop)
    x = F.col("x")
    runs = signal.groupBy(key, F.floor(F.col("n") / step).alias("__run")).agg(F.count("*").alias("c"), F.sum(x).alias("s"), F.sum(x * x).alias("q"), F.max(x).alias("m"))
    size = runs.groupBy(key).agg(F.sum("c").alias("__len"))
    dealt = _spread(runs.join(size, key), F.col("__run"), step, win, hop, drop_last)
    return dealt.groupBy(key, "frame").agg(F.sum("c").alias("count"), F.sum("s").alias("total"), F.sum("q").alias("square"), F.max("m").alias("top"))


def chunked(signal: DataFrame, key: str, size: int, before: int = 0, after: int = 0) -> DataFrame:
    """(key, chunk, rows): the rows of each `size` numbers n, sorted by n, with so many of the numbers before and behind.

    A signal is cut into chunks of bounded size, so a key with very many rows
    is spread over its chunks.
    """
    names = [c for c in signal.columns if c != key]
    n = F.col("n")
    each = signal.withColumn("chunk", F.explode(F.sequence(F.greatest(F.floor((n - after) / size), F.lit(0)), F.floor((n + before) / size))))
    return each.groupBy(key, "chunk").agg(F.array_sort(F.collect_list(F.struct("n", *[c for c in names if c != "n"]))).alias("rows"))


def streamed(signal: DataFrame, key: str, start: Callable, out: str = "y") -> DataFrame:
    """(key, n, out): a signal (key, n, x) through a treatment with state, in order of n; what comes out is numbered from 0.

    start() gives a treatment as in functions.stateful, with push and flush. A
    task holds one batch of samples, whatever the length of a signal.
    """
    n = int(signal.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = signal.schema[key].dataType.simpleString()
    rows = signal.select(key, F.col("n").cast("long").alias("n"), F.col("x").cast("double").alias("x")).repartition(n, key).sortWithinPartitions(key, "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, treat, count = None, None, 0

        def batch_of(y: np.ndarray) -> pa.RecordBatch:
            nonlocal count
            count += len(y)
            return pa.RecordBatch.from_arrays([pa.array([last] * len(y), of), pa.array(np.arange(count - len(y), count)), pa.array(y, pa.float64())], names=[key, "n", out])

        for batch in batches:
            keys, x = batch.column(0), batch.column(2).to_numpy(zero_copy_only=False)
            of, lo = keys.type, 0
            same = pc.fill_null(pc.equal(keys.slice(1), keys.slice(0, max(len(keys) - 1, 0))), False).to_numpy(zero_copy_only=False)
            for hi in np.append(np.flatnonzero(~same) + 1, len(x)) if len(x) else ():
                if treat is None or keys[lo].as_py() != last:
                    if treat is not None:
                        yield batch_of(treat.flush())
                    last, treat, count = keys[lo].as_py(), start(), 0
                yield batch_of(treat.push(x[lo:hi]))
                lo = hi
        if treat is not None:
            yield batch_of(treat.flush())

    return rows.mapInArrow(run, f"{key} {kind}, n long, {out} double")
