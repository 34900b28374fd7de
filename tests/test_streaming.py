"""The event jobs as streams: the same rows as in batch, once the watermark has passed."""

from __future__ import annotations

from pyspark.sql import functions as F

from kelpgrid.sources.tables import table
from kelpgrid.streaming import jobs


def stream(spark, small, tmp_path, name, last="2024-06-01 00:00:00"):
    """The events as a stream of two files, the second with a row that moves the watermark past all others."""
    events = table(spark, small, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    path = f"{tmp_path}/{name}"
    events.coalesce(1).write.parquet(path)
    end = events.limit(1).withColumn("ts", F.lit(last).cast("timestamp")).withColumn("event_type", F.lit("end"))
    end.write.mode("append").parquet(path)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path), events


def drained(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def test_daily_counts(spark, small, tmp_path):
    source, events = stream(spark, small, tmp_path, "daily")
    got = drained(jobs.daily_counts(source, "400 days"), "daily_counts", "complete")
    assert {tuple(r) for r in got.where("event_type <> 'end'").collect()} == {tuple(r) for r in jobs.daily_counts(events).collect()}


def test_rolling_cost(spark, small, tmp_path):
    source, events = stream(spark, small, tmp_path, "rolling")
    got = drained(jobs.rolling_cost(source, lateness="400 days"), "rolling_cost", "complete")
    assert {tuple(r) for r in got.where("start < '2024-05-01'").collect()} == {tuple(r) for r in jobs.rolling_cost(events).collect()}


def test_stuck_jobs(spark, tmp_path):
    starts = [("a", "2024-01-01 00:00:00"), ("b", "2024-01-01 00:00:00"), ("end", "2024-03-01 00:00:00")]
    ends = [("a", "2024-01-01 00:05:00"), ("b", "2024-01-01 01:00:00"), ("x", "2024-03-01 00:00:00")]
    frames = []
    for name, rows in (("s", starts), ("e", ends)):
        df = spark.createDataFrame(rows, "job string, t string").select("job", F.col("t").cast("timestamp").alias("ts"))
        df.write.parquet(f"{tmp_path}/{name}")
        frames.append((df, spark.readStream.schema(df.schema).parquet(f"{tmp_path}/{name}")))
    batch = {r.job for r in jobs.stuck_jobs(frames[0][0], frames[1][0]).collect()}
    assert batch == {"b", "end"}
    got = drained(jobs.stuck_jobs(frames[0][1], frames[1][1]), "stuck")
    assert {r.job for r in got.collect()} == {"b"}  # the last start still waits
