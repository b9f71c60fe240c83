"""Queries on the event log: streams run to their end, and the same over tables at rest."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..streaming import state
from .registry import ORACLE_SQL, QUERIES, query


def _stream(sql: str | None):
    """Register a function of the stream of events."""

    def put(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(state.event_stream(spark, f"{sf_dir}/events.parquet"))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


@_stream("SELECT event_type, min(event_id) AS first, count(*) AS n FROM events GROUP BY event_type")
def stream_log_once(events):
    return state.run_to_end(state.log_once(events, "event_type", "event_id"), "log-once", "complete")


@_stream("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_daily_counts(events):
    return state.run_to_end(state.tumbling_counts(events, "ts", "1 day", "1 hour", "event_type"), "daily", "complete")


@_stream("SELECT user_id, count(*) AS events, count(*) // 64 AS fired FROM events GROUP BY user_id")
def stream_step_counter(events):
    made = state.run_to_end(state.step_counter(events, "user_id", "value"), "steps", "update")
    return state.latest(made, "user_id", "events")


_PROGRESS = "WITH e AS (SELECT user_id, min(event_id) FILTER (WHERE event_type = (SELECT max(event_type) FROM events)) AS stop FROM events GROUP BY user_id) SELECT user_id, CASE WHEN any_value(stop) IS NOT NULL AND max(CASE WHEN event_type = (SELECT min(event_type) FROM events) THEN 1 ELSE 0 END) = 1 THEN 'failed then done' WHEN any_value(stop) IS NOT NULL THEN 'done' WHEN max(CASE WHEN event_type = (SELECT min(event_type) FROM events) THEN 1 ELSE 0 END) = 1 THEN 'failed' ELSE 'running' END AS status, count(*) AS n FROM events JOIN e USING (user_id) WHERE stop IS NULL OR event_id <= stop GROUP BY user_id"


def _kinds(table):
    found = table.agg(F.max("event_type").alias("done"), F.min("event_type").alias("failed")).first()
    return found.done, found.failed


@query(_PROGRESS)
def task_progress(t):
    """Status of each task, from its log at rest."""
    return state.task_progress(t("events"), "user_id", "event_type", "event_id", *_kinds(t("events")))


def stream_task_progress(spark, sf_dir: str):
    """The same from the stream, by keyed state."""
    path = f"{sf_dir}/events.parquet"
    made = state.task_progress(state.event_stream(spark, path), "user_id", "event_type", "event_id", *_kinds(spark.read.parquet(path)))
    return state.latest(state.run_to_end(made, "tasks", "update"), "user_id", "n")


QUERIES["stream_task_progress"], ORACLE_SQL["stream_task_progress"] = stream_task_progress, _PROGRESS


@_stream("SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id")
def stream_merge(events):
    return state.merge_batches(events, "user_id", "event_id", "merge")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 32")
def retention(t):
    """The newest 32 entries of each key."""
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return t("events").withColumn("r", rank).where("r <= 32").select("user_id", "event_id")


@query("SELECT event_id, user_id FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 3 DAY")
def recent_log(t):
    """Entries of the last three days."""
    newest = t("events").agg(F.max("ts").alias("newest"))
    return t("events").join(F.broadcast(newest), F.col("ts") > F.col("newest") - F.expr("INTERVAL 3 DAYS")).select("event_id", "user_id")


@query("SELECT user_id, island, count(*) AS n, string_agg(CAST(event_id AS VARCHAR), ' ' ORDER BY event_id) AS ids FROM (SELECT *, sum(CASE WHEN event_type = (SELECT min(event_type) FROM events) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS island FROM events) WHERE island > 0 GROUP BY ALL")
def assembled_runs(t):
    """Runs of events that begin at a starting event, assembled in order."""
    start = t("events").agg(F.min("event_type").alias("start_type"))
    rows = t("events").join(F.broadcast(start))
    so_far = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("island", F.sum((F.col("event_type") == F.col("start_type")).cast("long")).over(so_far)).where("island > 0")
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("event_id")), lambda x: x.cast("string")), " ")
    return rows.groupBy("user_id", "island").agg(F.count("*").alias("n"), ids.alias("ids"))


_CONTROLLED = """
WITH k AS (SELECT max(event_type) AS done, min(event_type) AS failed FROM events),
e AS (SELECT user_id, min(event_id) FILTER (WHERE event_type = done OR event_id % 97 = 0) AS stop FROM events, k GROUP BY user_id),
c AS (SELECT user_id, event_id, stop, event_type = failed AND event_id % 97 != 0 AS bad, event_id = stop AND event_id % 97 = 0 AS cancel FROM events JOIN e USING (user_id), k WHERE stop IS NULL OR event_id <= stop)
SELECT user_id, CASE WHEN bool_or(cancel) THEN 'cancelled' WHEN any_value(stop) IS NOT NULL AND bool_or(bad) THEN 'failed then done' WHEN any_value(stop) IS NOT NULL THEN 'done' WHEN bool_or(bad) THEN 'failed' ELSE 'running' END AS status, count(*) AS n
FROM c GROUP BY user_id
"""


def _two_sources(spark, sf_dir: str, condition: str, kind):
    """The event log and control rows made of it, two streams in union."""
    path = f"{sf_dir}/events.parquet"
    log = state.event_stream(spark, path).where(f"not ({condition})")
    control = state.event_stream(spark, path).where(condition).withColumn("event_type", kind)
    return log.unionByName(control)


@query(_CONTROLLED)
def cancelled_tasks(t):
    """Status of each task where control rows cancel some, from the log at rest."""
    kind = F.when(F.col("event_id") % 97 == 0, "cancel").otherwise(F.col("event_type"))
    return state.task_progress(t("events").withColumn("event_type", kind), "user_id", "event_type", "event_id", *_kinds(t("events")), cancel="cancel")


def stream_cancelled_tasks(spark, sf_dir: str):
    """The same from two streams in one keyed state."""
    both = _two_sources(spark, sf_dir, "event_id % 97 = 0", F.lit("cancel"))
    made = state.task_progress(both, "user_id", "event_type", "event_id", *_kinds(spark.read.parquet(f"{sf_dir}/events.parquet")), cancel="cancel")
    return state.latest(state.run_to_end(made, "cancelled", "update"), "user_id", "n")


QUERIES["stream_cancelled_tasks"], ORACLE_SQL["stream_cancelled_tasks"] = stream_cancelled_tasks, _CONTROLLED


def stream_log_generations(spark, sf_dir: str):
    """Messages counted once for each generation of their user, which reset rows begin."""
    both = _two_sources(spark, sf_dir, "event_id % 31 = 0", F.lit("reset"))
    own = both.withColumn("user_id", F.when(F.col("event_id") % (31 * 50) != 0, F.col("user_id")))
    return state.log_counts(own, "user_id", "event_type", "event_id", "reset", "generations")


QUERIES["stream_log_generations"] = stream_log_generations
ORACLE_SQL["stream_log_generations"] = """
SELECT user_id, generation, event_type, min(event_id) AS first, count(*) AS n
FROM (
  SELECT *, count(*) FILTER (WHERE event_id % 31 = 0 AND event_id % 1550 != 0) OVER (PARTITION BY user_id ORDER BY event_id)
    + count(*) FILTER (WHERE event_id % 1550 = 0) OVER (ORDER BY event_id) AS generation
  FROM events
) WHERE event_id % 31 != 0 GROUP BY user_id, generation, event_type
"""


def stream_chance_accumulator(spark, sf_dir: str):
    """The chance that grows with each failure, kept as the stream's state."""
    events = state.event_stream(spark, f"{sf_dir}/events.parquet").withColumn("draw", (F.col("event_id") * 37 + F.col("user_id")) % 100)
    return state.latest(state.run_to_end(state.chance_steps(events, "user_id", "event_id", "draw"), "chance", "update"), "user_id", "steps")


QUERIES["stream_chance_accumulator"] = stream_chance_accumulator
