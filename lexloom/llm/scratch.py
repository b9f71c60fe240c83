"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where none is set, a temporary folder in local mode and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path that no other call uses; Spark deletes it when the application ends."""
    path = f"{shared_dir(spark)}/lexloom-{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(where)
    return path


@contextmanager
def _held(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def short_plans(spark: SparkSession, most: int = 1 << 16):
    """Within it, Spark keeps at most so many characters of the text of a plan: a literal table is printed at each of its places."""
    return _held(spark, "spark.sql.maxPlanStringLength", str(most))


def groups_in_order(spark: SparkSession):
    """Within it, rows that stand in the order of a grouping's keys are grouped as they stand: no hash table, and no sort where that is full."""
    return _held(spark, "spark.sql.execution.replaceHashWithSortAgg", "true")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table once and read it again: cuts the lineage, survives the loss of executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with short_plans(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete the files of a table that ``written`` gave, once nothing reads it any more."""
    spark = table.sparkSession
    for path in {x.rpartition("/")[0] for x in table.inputFiles()}:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
