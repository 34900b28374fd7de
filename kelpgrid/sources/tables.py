"""Reading the star-schema and corpus tables, whether they are one file or a folder of parts."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[2])


def on_workers(spark: SparkSession) -> None:
    """Puts this library on the path of Python workers that start from the same place as the driver."""
    environment = spark.sparkContext.environment
    known = [p for p in environment.get("PYTHONPATH", "").split(":") if p]
    if ROOT not in known:
        environment["PYTHONPATH"] = ":".join([ROOT, *known])


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One parquet table below ``sf_dir`` (any path that Spark's readers can open), or some of its columns."""
    on_workers(spark)
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return rows.select(*columns) if columns else rows
