"""Run ledger: latest runs, recent runs, tasks and the comparison of two runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..constants import LEDGER_RUN_STATES, RUNS_PER_DAG, STAGE_RUN_STATES
from ..functions.text import changed_flag, duration_ms, mapped, signed_difference


def latest_runs(ledger: DataFrame, dag: str = "dag_id", order: str = "execution_date") -> DataFrame:
    """Latest run per DAG with status and duration (WIN-3).

    Written as a maximum per DAG: each task keeps one run per DAG before the shuffle.
    """
    last = ledger.groupBy(dag).agg(
        F.max(F.struct(order, "run_id", "state", "start_date", "end_date")).alias("r")
    )
    return last.select(
        dag,
        F.col("r.run_id").alias("run_id"),
        mapped("r.state", STAGE_RUN_STATES, "none").alias("status"),
        F.col("r.start_date").alias("last_run_at"),
        duration_ms("r.start_date", "r.end_date").alias("duration_ms"),
    )


def recent_runs(ledger: DataFrame, n: int = RUNS_PER_DAG, dag: str = "dag_id", order: str = "execution_date") -> DataFrame:
    """The ``n`` latest runs of every DAG, newest start first, runs without a start last (WIN-4, SET-2).

    Spark keeps the first ``n`` rows per DAG in every task before the shuffle (window group limit).
    """
    newest = W.partitionBy(dag).orderBy(F.col(order).desc(), F.col("run_id").desc())
    return (
        ledger.withColumn("_rn", F.row_number().over(newest))
        .where(F.col("_rn") <= n)
        .select(
            F.col("run_id").alias("id"),
            F.col(dag).alias("dag_id"),
            F.col("start_date").alias("started_at"),
            duration_ms("start_date", "end_date").alias("duration_ms"),
            mapped("state", LEDGER_RUN_STATES, "in_progress").alias("status"),
        )
        .orderBy(F.col("started_at").desc_nulls_last(), "id")
    )


def task_instances(tasks: DataFrame, dag_id: str | None = None, run_id=None) -> DataFrame:
    """Tasks with state, duration and try number, of one run when it is named (WIN-5)."""
    if dag_id is not None:
        tasks = tasks.where(F.col("dag_id") == dag_id)
    if run_id is not None:
        tasks = tasks.where(F.col("run_id") == run_id)
    return tasks.select(
        "task_id",
        mapped(F.coalesce("state", F.lit("none")), STAGE_RUN_STATES, "none").alias("state"),
        "start_date",
        "end_date",
        duration_ms("start_date", "end_date").alias("duration_ms"),
        F.coalesce("try_number", F.lit(1)).alias("try_number"),
    )


def run_entries(runs: DataFrame, run: str, values: str) -> DataFrame:
    """One row per run and map key."""
    return runs.select(run, F.explode(values).alias("key", "value"))


def run_diff(a: DataFrame, b: DataFrame, on: list[str], numeric: bool = True) -> DataFrame:
    """Values of two runs side by side over the union of their keys (JOIN-11, MTH-1)."""
    both = a.withColumnRenamed("value", "value_a").join(b.withColumnRenamed("value", "value_b"), on, "full_outer")
    difference: Column = signed_difference("value_a", "value_b") if numeric else changed_flag("value_a", "value_b")
    return both.select(*on, "value_a", "value_b", difference.alias("difference"))
