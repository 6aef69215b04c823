"""Queries over the run ledger; events stand in for runs and tasks, their type for the DAG."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import duration_seconds
from ..operators import runs as R
from .registry import query, table

# End of a run: its value in seconds after the start; every ninth run has not ended.
_LEDGER_SQL = """ledger AS (SELECT event_type AS dag_id, event_id AS run_id, ts + to_microseconds(event_id * 613 % 1000) AS start_date,
  CASE WHEN event_id % 9 <> 8 THEN ts + to_microseconds(CAST(round(value * 1000) AS BIGINT) * 1000 + event_id * 37 % 1000) END AS end_date,
  CASE event_id % 4 WHEN 0 THEN 'success' WHEN 1 THEN 'running' WHEN 2 THEN 'failed' ELSE 'queued' END AS state FROM events)"""


def ledger(spark, d):
    event = F.col("event_id")
    ts = F.unix_micros(F.col("ts").cast("timestamp"))
    # Both ends have microseconds of their own.
    started = F.timestamp_micros(ts + event * 613 % 1000)
    ended = F.timestamp_micros(ts + F.round(F.col("value") * 1000).cast("long") * 1000 + event * 37 % 1000)
    return table(spark, d, "events").select(
        F.col("event_type").alias("dag_id"),
        event.alias("run_id"),
        started.alias("execution_date"),
        started.alias("start_date"),
        F.when(event % 9 != 8, ended).alias("end_date"),
        F.when(event % 4 == 0, "success").when(event % 4 == 1, "running").when(event % 4 == 2, "failed")
        .otherwise("queued").alias("state"),
        F.col("user_id"),
    )


_MS = "CAST(floor((epoch_us(end_date) - epoch_us(start_date)) / 1000.0) AS BIGINT)"
_STATUS = "CASE state WHEN 'success' THEN '{0}' WHEN 'running' THEN 'in_progress' WHEN 'failed' THEN 'failed' ELSE '{1}' END"
_FORMAT = "'%Y-%m-%d %H:%M:%S.%f'"


def _text(column):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")


@query(
    "latest_run",
    f"""WITH {_LEDGER_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY dag_id ORDER BY start_date DESC, run_id DESC) AS rn FROM ledger)
SELECT dag_id, run_id, {_STATUS.format('completed', 'none')} AS status, strftime(start_date, {_FORMAT}) AS last_run_at,
  {_MS} AS duration_ms FROM r WHERE rn = 1""",
)
def latest_run(spark, d):
    """WIN-3, DAT-1."""
    return R.latest_runs(ledger(spark, d)).withColumn("last_run_at", _text("last_run_at"))


@query(
    "top5_runs",
    f"""WITH {_LEDGER_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY dag_id ORDER BY start_date DESC, run_id DESC) AS rn FROM ledger)
SELECT run_id AS id, dag_id, strftime(start_date, {_FORMAT}) AS started_at, {_MS} AS duration_ms,
  {_STATUS.format('succeeded', 'in_progress')} AS status FROM r WHERE rn <= 5""",
)
def top5_runs(spark, d):
    """WIN-4, SET-2."""
    return R.recent_runs(ledger(spark, d)).withColumn("started_at", _text("started_at"))


@query(
    "recent_runs_per_user",
    f"""WITH {_LEDGER_SQL}, u AS (SELECT l.*, e.user_id FROM ledger l JOIN events e ON e.event_id = l.run_id),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY start_date DESC, run_id DESC) AS rn FROM u)
SELECT run_id AS id, user_id, {_MS} AS duration_ms FROM r WHERE rn <= 5""",
)
def recent_runs_per_user(spark, d):
    """WIN-4 with many groups."""
    return R.recent_runs(ledger(spark, d), dag="user_id").select("id", F.col("dag_id").alias("user_id"), "duration_ms")


@query(
    "run_tasks",
    f"""WITH {_LEDGER_SQL}
SELECT run_id AS task_id, {_STATUS.format('completed', 'none')} AS state, {_MS} AS duration_ms,
  CAST(floor({_MS} / 1000.0 + 0.5) AS BIGINT) AS duration_s, CASE WHEN run_id % 5 = 0 THEN 1 ELSE CAST(run_id % 5 AS INTEGER) END AS try_number
FROM ledger""",
)
def run_tasks(spark, d):
    """WIN-5, DAT-1, MTH-3 over all tasks."""
    tries = F.col("run_id") % 5
    tasks = ledger(spark, d).select(
        F.col("run_id").alias("task_id"), "state", "start_date", "end_date",
        F.when(tries != 0, tries.cast("int")).alias("try_number"),
    )
    out = R.task_instances(tasks)
    return out.select("task_id", "state", "duration_ms", duration_seconds("duration_ms").alias("duration_s"), "try_number")


_DAYS_SQL = """n AS (SELECT date_diff('day', date '2024-01-01', CAST(ts AS DATE)) AS run, event_type AS key, count(*) AS value
  FROM (SELECT ts, CASE WHEN event_type = 'error' AND hour(ts) >= 12 THEN 'late error' ELSE event_type END AS event_type FROM events) GROUP BY ALL)"""


@query(
    "run_diff",
    f"""WITH {_DAYS_SQL}, a AS (SELECT run + 1 AS run, key, value FROM n), b AS (SELECT run, key, value FROM n)
SELECT coalesce(a.run, b.run) AS run, coalesce(a.key, b.key) AS key, a.value AS value_a, b.value AS value_b,
  CASE WHEN a.value IS NULL OR b.value IS NULL THEN '' WHEN b.value > a.value THEN '+' || CAST(b.value - a.value AS VARCHAR)
  ELSE CAST(b.value - a.value AS VARCHAR) END AS difference
FROM a FULL JOIN b ON a.run = b.run AND a.key = b.key""",
)
def run_diff(spark, d):
    """JOIN-11, MTH-1, SORT-1, SET-3: every day's counts per type against the day before."""
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("long")
    # A type that some days lack.
    late = (F.col("event_type") == "error") & (F.hour("ts") >= 12)
    events = table(spark, d, "events").withColumn("event_type", F.when(late, "late error").otherwise(F.col("event_type")))
    counts = events.groupBy(day.alias("run"), F.col("event_type").alias("key")).agg(F.count("*").alias("value"))
    # One map per run, as the ledger keeps it: as many entries as there are event types.
    runs = counts.groupBy("run").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("stage_counts"))
    entries = R.run_entries(runs, "run", "stage_counts")
    before = entries.withColumn("run", F.col("run") + 1)
    return R.run_diff(before, entries, ["run", "key"]).orderBy("run", "key")


@query(
    "run_config_diff",
    """WITH c AS (SELECT user_id AS run, event_type AS key, arg_max(event_id % 2 = 0, (ts, event_id)) AS value FROM events GROUP BY ALL),
a AS (SELECT run + 1 AS run, key, value FROM c)
SELECT coalesce(a.run, c.run) AS run, coalesce(a.key, c.key) AS key, a.value AS value_a, c.value AS value_b,
  CASE WHEN a.value IS NULL OR c.value IS NULL THEN '' WHEN a.value = c.value THEN '동일' ELSE '변경' END AS difference
FROM a FULL JOIN c ON a.run = c.run AND a.key = c.key""",
)
def run_config_diff(spark, d):
    """JOIN-11, MTH-1 on values that are not numbers."""
    events = table(spark, d, "events")
    last = events.groupBy(F.col("user_id").alias("run"), F.col("event_type").alias("key")).agg(
        F.max_by(F.col("event_id") % 2 == 0, F.struct("ts", "event_id")).alias("value")
    )
    return R.run_diff(last.withColumn("run", F.col("run") + 1), last, ["run", "key"], numeric=False)
