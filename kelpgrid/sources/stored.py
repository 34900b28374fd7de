"""Tables that are derived once and read many times, in the folder that the whole cluster shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_folders: dict[str, str] = {}
_built: dict[tuple, str] = {}


def folder(spark: SparkSession) -> str:
    """A folder of this application below ``spark.checkpoint.dir``; only a session on one machine without that setting gets a temporary one."""
    app = spark.sparkContext.applicationId
    if app not in _folders:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            root = tempfile.mkdtemp(prefix="kelpgrid-")
            atexit.register(shutil.rmtree, root, True)
        _folders[app] = f"{root.rstrip('/')}/kelpgrid-tables-{uuid.uuid4().hex}"
    return _folders[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written once and read again: lineage that outlives lost executors."""
    path = new_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def built_once(spark: SparkSession, name: str, source: str, build: Callable[[str], None]) -> str:
    """The path of a derived table of one source, which ``build(path)`` writes on first use in this application."""
    key = (spark.sparkContext.applicationId, name, source)
    if key not in _built:
        path = new_path(spark, name)
        build(path)
        _built[key] = path
    return _built[key]
