"""Event streams: daily counts, rolling cost and jobs that never end. Each takes a streaming or a batch DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def daily_counts(events: DataFrame, lateness: str = "1 day") -> DataFrame:
    """``day, event_type, n, value``: tumbling days of event time; later events than ``lateness`` are dropped by the watermark."""
    timed = events.withWatermark("ts", lateness) if events.isStreaming else events
    grouped = timed.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))
    return grouped.select(F.col("w.start").alias("day"), "event_type", "n", "value")


def rolling_cost(events: DataFrame, length: str = "24 hours", slide: str = "6 hours", lateness: str = "1 day") -> DataFrame:
    """``start, n, value`` of sliding windows."""
    timed = events.withWatermark("ts", lateness) if events.isStreaming else events
    grouped = timed.groupBy(F.window("ts", length, slide).alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))
    return grouped.select(F.col("w.start").alias("start"), "n", "value")


def stuck_jobs(started: DataFrame, ended: DataFrame, minutes: int = 15) -> DataFrame:
    """``job, ts``: starts without an end within ``minutes``. Streams need watermarks: a start is given up once the end's have passed it."""
    s, e = started.select("job", "ts").alias("s"), ended.select(F.col("job").alias("e_job"), F.col("ts").alias("e_ts")).alias("e")
    if started.isStreaming:
        s, e = s.withWatermark("ts", "1 minute"), e.withWatermark("e_ts", "1 minute")
    within = F.expr(f"job = e_job AND e_ts >= ts AND e_ts <= ts + INTERVAL {minutes} MINUTES")
    return s.join(e, within, "left").where("e_job is null").select("job", "ts")


def claim(queue: DataFrame, as_of: str, n: int, lease_minutes: int = 10) -> DataFrame:
    """The n queued rows, or rows whose lease has run out, of the highest priority; earlier ones first."""
    at = F.lit(as_of).cast("timestamp_ntz")
    open_ = (F.col("state") == "queued") | ((F.col("state") == "processing") & (F.col("started_at") < at - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(lease_minutes))))
    return queue.where(open_).orderBy(F.desc("priority"), "enqueued_at", "id").limit(n)


def over_limit(events: DataFrame, key: str, seconds: int, most: int) -> DataFrame:
    """Events that are not among the first ``most`` of their key within the ``seconds`` before them."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy(key).orderBy("at").rangeBetween(-seconds * 1_000_000 + 1, 0)
    return events.withColumn("at", at).withColumn("in_window", F.count("*").over(w)).where(F.col("in_window") > most).drop("at")


def sessions(events: DataFrame, key: str, gap: str = "30 minutes") -> DataFrame:
    """``key, start, n``: runs of events with no gap longer than ``gap``."""
    timed = events.withWatermark("ts", "1 hour") if events.isStreaming else events
    grouped = timed.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return grouped.select(key, F.col("w.start").alias("start"), "n")
