"""Running sums within groups of any size, and tables written between steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..streaming.state import work_folder


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder, read back, which cuts their lineage; Spark deletes it when the application ends."""
    spark = df.sparkSession
    path = work_folder(spark, name)
    df.write.parquet(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def with_running(rows: DataFrame, group: list[str], order: list[str], value: Column, name: str = "before") -> DataFrame:
    """The rows with ``name``: the sum of a whole number over the rows of the same group that come before, 0 for the first.

    Rows are dealt by ranges of (group, order), so a group may be of any size: each
    range is summed on its own, and a range goes on from what the ranges before have of
    the group that it begins with, one number for each range. Null is a group of its
    own and comes first in the order; rows that are equal in the whole order follow
    each other in any way, so it should end with a key.
    """
    ranged = rows.withColumn("value_", value.cast("long")).repartitionByRange(*[F.col(c) for c in [*group, *order]])
    ranged = written(ranged.withColumn("range_", F.spark_partition_id()), "running")
    own = Window.partitionBy("range_", *group).orderBy(*order)
    inside = F.coalesce(F.sum("value_").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    key = F.struct(*[F.col(c) for c in group]) if group else F.struct(F.lit(0))
    sums = ranged.groupBy("range_", key.alias("group_")).agg(F.sum("value_").alias("sum_"))
    # Only the first group of a range can have begun before it: one row for each range is sent to the tasks.
    earlier = F.sum("sum_").over(Window.partitionBy("group_").orderBy("range_").rowsBetween(Window.unboundedPreceding, -1))
    carried = sums.withColumn("carried_", earlier).where("carried_ is not null").select("range_", "group_", "carried_")
    both = ranged.withColumns({"inside_": inside, "group_": key}).alias("r").join(F.broadcast(carried.alias("c")), F.col("r.range_").eqNullSafe(F.col("c.range_")) & F.col("r.group_").eqNullSafe(F.col("c.group_")), "left")
    return both.select(*[F.col(f"r.{c}") for c in rows.columns], (F.col("r.inside_") + F.coalesce("c.carried_", F.lit(0))).alias(name))
