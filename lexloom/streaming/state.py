"""Keyed state over event streams; each operator also reads a batch table."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .tables import KeyedTable, merged_stream


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``; where that is not set, a temporary one in local mode and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-stream-')}"
    return f"{found.rstrip('/')}/lexloom-{name}-{uuid.uuid4().hex}"


def event_stream(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """A table's files (a folder's, or one file) as a stream, so many in each micro-batch."""
    schema = spark.read.parquet(path).schema
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    if where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(where).isFile():
        # The source reads folders: the file is named by a filter on its own.
        return reader.option("pathGlobFilter", where.getName()).parquet(where.getParent().toString())
    return reader.parquet(path)


def run_to_end(stream: DataFrame, name: str, mode: str = "append", folder: str | None = None) -> DataFrame:
    """Process all that is there, with a checkpoint, and return the rows written.

    In complete mode each batch replaces the table; otherwise it adds to it under
    its number, so a repeated batch does not add twice. With a ``folder`` of its own a
    stream goes on where it was stopped, in any session; else it starts anew.
    """
    spark = stream.sparkSession
    folder = folder or work_folder(spark, name)

    def put(batch: DataFrame, number: int) -> None:
        target = f"{folder}/out" if mode == "complete" else f"{folder}/out/batch={number}"
        batch.write.mode("overwrite").parquet(target)

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(put).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").select(stream.columns)


def log_once(events: DataFrame, key: str, value: str) -> DataFrame:
    """Each key once, with its least value and how often it came."""
    return events.groupBy(key).agg(F.min(value).alias("first"), F.count("*").alias("n"))


def tumbling_counts(events: DataFrame, ts: str, width: str, late: str, *keys: str) -> DataFrame:
    """Counts of windows of time; rows later than the watermark are left out of a stream."""
    # Wall-clock times are taken as UTC, whatever the session's zone is, and given back as wall-clock times.
    zone = F.current_timezone()
    source = events.withColumn(ts, F.from_utc_timestamp(F.col(ts).cast("timestamp"), zone))
    source = source.withWatermark(ts, late) if events.isStreaming else source
    start = F.to_utc_timestamp("w.start", zone).cast("timestamp_ntz")
    return source.groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count("*").alias("n")).select(start.alias("start"), *keys, "n")


def distinct_within(events: DataFrame, ts: str, late: str, keys: list[str]) -> DataFrame:
    """The first row of each key within the watermark."""
    if events.isStreaming:
        return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)
    return events.dropDuplicates(keys)


#: Points that fill a step counter.
STEPS = 64


def step_counter(events: DataFrame, key: str, value: str, steps: int = STEPS) -> DataFrame:
    """(key, total, fired): how often each key's running number of events has filled the counter."""

    def update(keys: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        count, total = state.get if state.exists else (0, 0.0)
        for pdf in frames:
            count += len(pdf)
            total += float(pdf[value].sum())
        state.update((count, total))
        yield pd.DataFrame({key: [keys[0]], "events": [count], "fired": [count // steps]})

    kind = dict(events.dtypes)[key]
    schema = f"{key} {kind}, events long, fired long"
    if events.isStreaming:
        return events.groupBy(key).applyInPandasWithState(update, schema, "events long, total double", "update", "NoTimeout")
    return events.groupBy(key).agg(F.count("*").alias("events")).withColumn("fired", F.floor(F.col("events") / steps))


def in_order(frames: Iterator[pd.DataFrame], *order: str) -> pd.DataFrame:
    """All rows of a key in one batch, sorted: they come in pieces of no order."""
    return pd.concat(list(frames), ignore_index=True).sort_values(list(order), kind="stable")


def task_progress(events: DataFrame, task: str, kind: str, order: str, done: str, failed: str, cancel: str | None = None) -> DataFrame:
    """(task, status, n): done at the first end event, failed if an error came before it; later events are not counted.

    cancel: the kind of a control row, which may come from another source in union with
    the log; at its place in the order it ends a task that runs as "cancelled". Rows of
    one batch count in their order, however they come; batches in theirs.
    """
    ended = ("done", "failed then done", "cancelled")

    def update(keys: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        count, status = state.get if state.exists else (0, "running")
        for r in in_order(frames, order)[kind]:
            if status in ended:
                break
            count += 1
            if r == failed:
                status = "failed"
            elif r == done:
                status = "failed then done" if status == "failed" else "done"
            elif cancel is not None and r == cancel:
                status = "cancelled"
        state.update((count, status))
        yield pd.DataFrame({task: [keys[0]], "status": [status], "n": [count]})

    schema = f"{task} {dict(events.dtypes)[task]}, status string, n long"
    if events.isStreaming:
        return events.groupBy(task).applyInPandasWithState(update, schema, "n long, status string", "update", "NoTimeout")
    # The table at rest: the end is the least order of an end event or a control row.
    ends = [done] if cancel is None else [done, cancel]
    end = F.when(F.col(kind).isin(ends), F.col(order))
    ends = events.groupBy(task).agg(F.min(end).alias("end_"), F.min_by(kind, end).alias("end_kind_"))
    rows = events.join(ends, task).where(F.col("end_").isNull() | (F.col(order) <= F.col("end_")))
    bad = F.max((F.col(kind) == failed).cast("int")) == 1
    over = F.first("end_").isNotNull()
    stopped = F.coalesce(F.first("end_kind_") == F.lit(cancel), F.lit(False))
    status = F.when(stopped, "cancelled").when(over & bad, "failed then done").when(over, "done").when(bad, "failed").otherwise("running")
    return rows.groupBy(task).agg(status.alias("status"), F.count("*").alias("n"))


def latest(updates: DataFrame, key: str, grows: str) -> DataFrame:
    """The last update of each key, by a count that grows."""
    rest = [c for c in updates.columns if c != key]
    return updates.groupBy(key).agg(F.max_by(F.struct(*rest), grows).alias("x")).select(key, "x.*")


def merge_batches(stream: DataFrame, key: str, value: str, name: str, folder: str | None = None) -> DataFrame:
    """A table of the latest value of each key (of the last batch that has it, there the largest), merged batch by batch.

    With a ``folder`` of its own the stream goes on where it was stopped; a batch that
    runs again changes nothing.
    """
    spark = stream.sparkSession
    kinds = dict(stream.dtypes)
    table = KeyedTable(spark, folder or work_folder(spark, name), f"{key} {kinds[key]}, {value} {kinds[value]}", [key])

    def merged(old: DataFrame, batch: DataFrame) -> DataFrame:
        own = batch.groupBy(key).agg(F.max(value).alias(value))
        return own.unionByName(old.join(own, key, "left_anti"))

    merged_stream(stream, table, merged)
    return table.rows()


def log_counts(stream: DataFrame, prefix: str, message: str, order: str, reset: str, name: str, folder: str | None = None) -> DataFrame:
    """(prefix, generation, message, first, n): each message once per generation, with its first place and how often it came.

    Rows whose message is ``reset`` are control rows, which may come from another source
    in union with the log: at their place in the order they begin a new generation of
    their prefix, or of every prefix where theirs is null. Resets before a row are
    running sums over ranges of the rows (``running``), so there may be any number of
    them, and a prefix or message may have any share of the rows. Restarts as ``merge_batches``. Null messages are left out.
    """
    from ..operators.running import with_running

    spark = stream.sparkSession
    kinds = dict(stream.dtypes)
    folder = folder or work_folder(spark, name)
    counts = KeyedTable(spark, f"{folder}/counts", f"{prefix} {kinds[prefix]}, generation long, {message} {kinds[message]}, first {kinds[order]}, n long", [prefix, "generation", message])
    resets = KeyedTable(spark, f"{folder}/resets", f"{prefix} {kinds[prefix]}, n long", [prefix])

    def put(batch: DataFrame, number: int) -> None:
        control = F.col(message) == reset
        rows = batch.where(F.col(message).isNotNull()).select(prefix, message, order, control.cast("int").alias("mark_"))
        # A reset at the place of a row comes behind it.
        rows = with_running(rows, [], [order, "mark_"], F.col("mark_") * F.col(prefix).isNull().cast("int"), "all_")
        rows = with_running(rows, [prefix], [order, "mark_"], F.col("mark_") * F.col(prefix).isNotNull().cast("int"), "own_").where("mark_ = 0")
        before = resets.rows(resets.manifest(before=number)).select(F.col(prefix).alias("of_"), F.col("n").alias("before_"))
        rows = rows.join(before.where("of_ is not null"), F.col(prefix) == F.col("of_"), "left").drop("of_")
        # One row: the resets of every prefix.
        rows = rows.join(F.broadcast(before.where("of_ is null").select(F.col("before_").alias("all_before_"))), F.lit(True), "left")
        rows = rows.withColumn("generation", F.col("all_") + F.col("own_") + F.coalesce("before_", F.lit(0)) + F.coalesce("all_before_", F.lit(0)))
        own = rows.groupBy(prefix, "generation", message).agg(F.min(order).alias("first"), F.count("*").alias("n"))
        both = lambda old, new: old.unionByName(new).groupBy(prefix, "generation", message).agg(F.min("first").alias("first"), F.sum("n").alias("n"))
        counts.merge(own, number, both)
        new = batch.where(control).groupBy(prefix).agg(F.count("*").alias("n"))
        resets.merge(new, number, lambda old, new: old.unionByName(new).groupBy(prefix).agg(F.sum("n").alias("n")))

    query = stream.writeStream.option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(put)
    query.trigger(availableNow=True).start().awaitTermination()
    return counts.rows()


def chance_steps(events: DataFrame, key: str, order: str, draw: str, base: int = 10, grows: int = 5) -> DataFrame:
    """(key, steps, fired, chance) after each batch of a stream: a chance that grows with each failure and falls back when it fires."""

    def update(keys: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        steps, fired, chance = state.get if state.exists else (0, 0, base)
        for x in in_order(frames, order)[draw].tolist():
            steps += 1
            fires = x < chance
            fired += fires
            chance = base if fires else chance + grows
        state.update((steps, fired, chance))
        yield pd.DataFrame({key: [keys[0]], "steps": [steps], "fired": [fired], "chance": [chance]})

    schema = f"{key} {dict(events.dtypes)[key]}, steps long, fired long, chance int"
    rows = events.select(key, order, draw)
    return rows.groupBy(key).applyInPandasWithState(update, schema, "steps long, fired long, chance int", "update", "NoTimeout")
