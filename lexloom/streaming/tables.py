"""Keyed tables that a stream merges into, batch by batch, and that survive a stop at any point.

A table is a folder: ``data/batch=N/bucket=K`` holds the rows of bucket K as batch N left
them, and ``manifests/N`` names, for each bucket, the batch that wrote it last. A batch
reads and rewrites only the buckets of its own keys, then commits its manifest in one
step. A batch that runs again (its manifest was not written, or was but the stream's own
checkpoint was not) starts from the manifest before it and gives the same table.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Buckets of a table; fixed once a table is written.
BUCKETS = 64


class KeyedTable:
    """Rows of ``schema`` (a DDL string that has the keys) at ``path``, on any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int = BUCKETS):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path.rstrip("/"), schema, keys, buckets

    def _fs(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), where

    def _commit(self, number: int, own: dict[int, int]) -> None:
        fs, made = self._fs(f"{self.path}/manifests/.{number}")
        out = fs.create(made, True)
        out.write(json.dumps(own).encode())
        out.close()
        _, there = self._fs(f"{self.path}/manifests/{number}")
        fs.delete(there, False)
        fs.rename(made, there)

    def manifest(self, before: int | None = None) -> dict[int, int]:
        """Bucket and the batch that wrote it, of the last manifest, or of the last before a batch."""
        fs, where = self._fs(f"{self.path}/manifests")
        if not fs.exists(where):
            return {}
        names = [x.getPath().getName() for x in fs.listStatus(where)]
        numbers = [int(x) for x in names if x.isdigit() and (before is None or int(x) < before)]
        if not numbers:
            return {}
        text = self.spark.read.text(f"{self.path}/manifests/{max(numbers)}", wholetext=True).first().value
        return {int(k): v for k, v in json.loads(text).items()}

    def rows(self, manifest: dict[int, int] | None = None) -> DataFrame:
        """The table, or the buckets of a manifest."""
        manifest = self.manifest() if manifest is None else manifest
        paths = [f"{self.path}/data/batch={n}/bucket={k}" for k, n in sorted(manifest.items())]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def merge(self, batch: DataFrame, number: int, merged: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """Put ``merged(old rows, batch)`` in place of the rows of the buckets that the batch touches."""
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        touched = [r.bucket for r in batch.select(bucket.alias("bucket")).distinct().collect()]  # BUCKETS at most
        known = self.manifest(before=number)
        old = self.rows({k: known[k] for k in touched if k in known})
        columns = old.columns
        made = merged(old, batch).select(*columns).withColumn("bucket", bucket)
        # One task writes a bucket's rows, or several if it has many; a bucket is a folder.
        made.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/batch={number}")
        fs, _ = self._fs(self.path)
        there = {k for k in touched if fs.exists(self._fs(f"{self.path}/data/batch={number}/bucket={k}")[1])}
        self._commit(number, {k: n for k, n in known.items() if k not in touched} | dict.fromkeys(there, number))


def merged_stream(stream: DataFrame, table: KeyedTable, merged: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    """Merge all that the stream has, from where its checkpoint in the table's folder stopped."""
    query = stream.writeStream.option("checkpointLocation", f"{table.path}/checkpoint").foreachBatch(lambda batch, number: table.merge(batch, number, merged))
    query.trigger(availableNow=True).start().awaitTermination()
