"""Queries that run as streams over the event files until all is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempograph.plans import signals
from tempograph.plans.signals import _SIGNAL, POLE
from tempograph.streaming import meters


def stream_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = meters.hop_counts(meters.files(spark, sf_dir, "events"), "4 hours", "2 hours", "60 days", "event_type")
    found = meters.drain(counts, "update")
    latest = found.groupBy("start", "event_type").agg(F.max(F.struct("batch", "n", "total")).alias("l"))
    return latest.select("start", "event_type", F.col("l.n").alias("n"), F.round("l.total", 2).alias("total"))


def stream_tumble(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = meters.drain(meters.hop_counts(meters.files(spark, sf_dir, "events"), "6 hours", None, "60 days", "event_type"), "update")
    latest = found.groupBy("start", "event_type").agg(F.max(F.struct("batch", "n", "total")).alias("l"))
    return latest.select("start", "event_type", F.col("l.n").alias("n"), F.round("l.total", 2).alias("total"))


def stream_limiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`limiter_fold` as a stream; what the limiter holds comes out when the input ends."""
    signal = meters.files(spark, sf_dir, "events").select("user_id", "ts", "event_id", ((F.col("value") - 50) / 50).alias("x"))
    settings = (0.9, 0.8, 3, 2)
    found = meters.drain(meters.running_limiter(signal, *settings), "update")
    return meters.flushed(found, *settings).select("user_id", "n", F.round("y", 6).alias("y"))


def stream_meter(spark: SparkSession, sf_dir: str) -> DataFrame:
    signal = meters.files(spark, sf_dir, "events").select("user_id", "ts", "event_id", ((F.col("value") - 50) / 50).alias("x"))
    found = meters.drain(meters.running_meter(signal, POLE), "update")
    latest = found.groupBy("user_id").agg(F.max(F.struct("batch", "frames", "peak", "sum_sq", "pole")).alias("l"))
    return latest.select("user_id", F.col("l.frames").alias("frames"), F.round("l.peak", 6).alias("peak"), F.round("l.sum_sq", 4).alias("sum_sq"), F.round("l.pole", 6).alias("pole"))


SQL = {
    "stream_hop": """SELECT epoch(s)::BIGINT AS start, event_type, count(*) AS n, round(sum(value), 2) AS total
FROM (SELECT event_type, value, unnest([time_bucket(INTERVAL 2 HOURS, ts), time_bucket(INTERVAL 2 HOURS, ts) - INTERVAL 2 HOURS]) AS s FROM events) GROUP BY ALL""",
    "stream_tumble": "SELECT epoch(time_bucket(INTERVAL 6 HOURS, ts))::BIGINT AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL",
    "stream_limiter": signals.SQL["limiter_fold"],
    "stream_meter": f"""WITH RECURSIVE s AS ({_SIGNAL[1:-1]}),
f AS (SELECT user_id, n, {POLE} * x AS y FROM s WHERE n = 0 UNION ALL SELECT f.user_id, f.n + 1, {1 - POLE} * y + {POLE} * x FROM f JOIN s ON s.user_id = f.user_id AND s.n = f.n + 1),
l AS (SELECT user_id, arg_max(y, n) AS y FROM f GROUP BY 1)
SELECT s.user_id, count(*) AS frames, round(max(abs(x)), 6) AS peak, round(sum(x * x), 4) AS sum_sq, round(any_value(l.y), 6) AS pole FROM s JOIN l USING (user_id) GROUP BY 1""",
}
QUERIES = {name: globals()[name] for name in SQL}
