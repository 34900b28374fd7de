"""A keyed table on shared storage: upserts that are written bucket by bucket, once for each batch id.

The table is a folder of generations of buckets. A bucket's current generation is named by the newest manifest, a small
JSON file that is put in place by one rename; a batch writes new generations of the buckets that it touches and then
its manifest. Whatever a killed batch left has no manifest, and a batch whose id is in the manifest is not applied again.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kelpgrid.sources.files import merge_fields, upsert


class KeyedTable:
    """Rows of one schema, one for each value of ``key``; a single writer at a time, any number of readers."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str, key: str, buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema

    def _fs(self):
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(context._jsc.hadoopConfiguration()), context._jvm.org.apache.hadoop.fs.Path

    def _manifests(self) -> list[int]:
        fs, path = self._fs()
        folder = path(f"{self.path}/manifests")
        if not fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def manifest(self) -> dict:
        """``version``, the ``generation`` of each bucket, and the ``batches`` applied."""
        versions = self._manifests()
        if not versions:
            return {"version": 0, "generation": {}, "batches": {}}
        text = "".join(r.value for r in self.spark.read.text(f"{self.path}/manifests/{versions[-1]}.json", wholetext=True).collect())
        return json.loads(text)

    def _commit(self, manifest: dict) -> None:
        fs, path = self._fs()
        final = path(f"{self.path}/manifests/{manifest['version']}.json")
        draft = path(f"{self.path}/manifests/.{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(json.dumps(manifest).encode())
        out.close()
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, False)
            raise RuntimeError(f"version {manifest['version']} was written by another writer")

    def _read(self, generation: dict[str, str]) -> DataFrame:
        paths = [f"{self.path}/data/{g}/bucket={b}" for b, g in sorted(generation.items())]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        """All rows as of the newest manifest."""
        return self._read(self.manifest()["generation"])

    def apply(self, incoming: DataFrame, batch: int | None = None, stream: str = "", merge: bool = False, ignore: bool = False) -> bool:
        """Upserts a batch; False if a batch of this id or a later one of ``stream`` was applied before.

        ``merge`` keeps existing values where incoming ones are null, ``ignore`` keeps existing rows; of several incoming
        rows of one key one stays, the same on each run. Rows without a key are left out. Only the buckets that the batch
        has keys of are read and written; they are written by key, so no task holds a bucket of a frequent key alone.
        """
        now = self.manifest()
        if batch is not None and now["batches"].get(stream, -1) >= batch:
            return False
        key = F.col(self.key)
        number = F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in incoming.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields]
        rows = incoming.where(key.isNotNull()).select(*columns)
        touched = sorted(r.b for r in rows.select(number.alias("b")).distinct().collect())  # at most one for each bucket
        if touched:
            old = self._read({b: g for b, g in now["generation"].items() if int(b) in touched})
            one = upsert(rows.limit(0), rows, self.key)  # one incoming row a key
            merged = merge_fields(old, one, self.key) if merge and not ignore else upsert(old, one, self.key, ignore)
            generation = uuid.uuid4().hex
            merged.select(*self.schema.names).withColumn("bucket", number).hint("rebalance", F.col("bucket")).write.partitionBy("bucket").parquet(f"{self.path}/data/{generation}")
            now["generation"] |= {str(b): generation for b in touched}
        if batch is not None:
            now["batches"][stream] = batch
        now["version"] += 1
        self._commit(now)
        return True

    def sink(self, stream: str, **options):
        """For ``writeStream.foreachBatch``: every batch once, replays are known by their id."""
        return lambda rows, batch: self.apply(rows, batch, stream, **options) and None

    def vacuum(self) -> int:
        """Removes generations that the newest manifest does not name, and older manifests; readers of these must be done. How many went."""
        fs, path = self._fs()
        now, gone = self.manifest(), 0
        folder = path(f"{self.path}/data")
        live = set(now["generation"].values())
        for f in fs.listStatus(folder) if fs.exists(folder) else []:
            if f.getPath().getName() not in live:
                fs.delete(f.getPath(), True)
                gone += 1
        for v in self._manifests()[:-1]:
            fs.delete(path(f"{self.path}/manifests/{v}.json"), False)
        return gone
