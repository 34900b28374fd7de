"""Tables written between jobs, in the folder that the whole cluster shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application below ``spark.checkpoint.dir``, removed when Python ends.

    The setting is read from the session; only where it is unset (tests on one machine) is a
    temporary folder used.
    """
    app = spark.sparkContext.applicationId
    if app not in _folders:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            root = tempfile.mkdtemp(prefix="kelpgrid-")
            atexit.register(shutil.rmtree, root, True)
        _folders[app] = f"{root.rstrip('/')}/kelpgrid-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, _folders[app])
    return _folders[app]


def _remove(spark: SparkSession, folder: str) -> None:
    context = spark.sparkContext
    if context._jsc is None:  # stopped before; a folder of a stopped application may be removed by hand
        return
    try:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    except Exception as error:  # the JVM may already have gone; nothing depends on the folder
        print(f"{folder} was left behind: {error}")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, name: str, compression: str = "zstd", group_rows: int | None = None) -> DataFrame:
    """Writes ``df`` once and returns the written table: cut lineage that outlives lost executors.

    Tasks hold a row group when they write, and one decoded when they read. Its size is first looked at after a hundred rows:
    ``group_rows`` bounds it for rows of megabytes.
    """
    path = new_path(df.sparkSession, name)
    options = {"compression": compression} | ({} if group_rows is None else {"parquet.block.row.count.limit": str(group_rows)})
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def id_text(id_col: str) -> Column:
    """An id, cast to a long, as text: pandas holds longs with a null among them as doubles, which rounds ids above 2^53."""
    return F.col(id_col).cast("long").cast("string")


def with_long_id(df: DataFrame, *ids: str) -> DataFrame:
    """``df`` with the ids that :func:`id_text` made text as longs again."""
    return df.withColumns({c: F.col(c).cast("long") for c in ids or ("doc_id",)})


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bounded_sample(df: DataFrame, key: str, most: int) -> DataFrame:
    """The ``most`` rows with the least hashes of ``key``, ties in the order of the key; all rows if there are fewer.

    Only hashes below a bound that leaves about a quarter more rows than asked for are sorted, so that what tasks send on
    does not grow with their number.
    """
    total = df.count()
    share = min(1.0, (1.25 * most + 50) / max(1, total))
    least = df.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int(share * (1 << 30)))
    return least.orderBy(F.pmod(F.xxhash64(key), F.lit(1 << 30)), key).limit(most)
