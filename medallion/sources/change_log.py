"""Change log read in rounds, with the processed ids committed beside the events they gave (SNK-8)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import DEFAULT_PROFILE, SourceProfile
from ..operators.cdc import log_operation, row_events

_ROUND = "round="


def _committed(spark: SparkSession, path: str) -> list[int]:
    """Rounds whose write was committed, in order."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    names = [str(s.getPath().getName()) for s in files.listStatus(folder)]
    rounds = [int(n.removeprefix(_ROUND)) for n in names if n.startswith(_ROUND)]
    whole = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return sorted(r for r in rounds if files.exists(whole(f"{path}/{_ROUND}{r}/_SUCCESS")))


def committed_events(spark: SparkSession, path: str, only: int | None = None) -> DataFrame | None:
    """Events of all committed rounds, or of one, with ``log_id`` and ``round``; None before the first."""
    rounds = [r for r in _committed(spark, path) if only in (None, r)]
    if not rounds:
        return None
    return spark.read.option("basePath", path).parquet(*[f"{path}/{_ROUND}{r}" for r in rounds])


def processed_ids(spark: SparkSession, path: str) -> DataFrame | None:
    """Ids of the log rows that committed rounds have read: what ``mark_processed`` takes."""
    events = committed_events(spark, path)
    return None if events is None else events.select(F.col("log_id").alias("id"))


def run_round(
    spark: SparkSession, log: DataFrame, path: str, primary_key: Sequence[str], operation: str = "operation",
    profile: SourceProfile = DEFAULT_PROFILE,
) -> int:
    """One round: the log's unprocessed rows that no committed round has read become events; returns the round's number.

    An event row holds the id it came from, so events and marks are one write and one commit: either both are there or
    neither.  A round that dies leaves a folder without a commit; the next one has its number and overwrites it, so a
    replay neither loses nor doubles a row.  Rows whose ids come late, below ids of earlier rounds, are read too.  The
    log itself need not be writable; its own ``processed`` flag is respected.
    """
    before = _committed(spark, path)
    pending = log.where(~F.col("processed"))
    done = processed_ids(spark, path)
    if done is not None:
        pending = pending.join(done, "id", "left_anti")
    events = row_events(pending, log_operation(operation), primary_key, profile=profile, keep=["id"])
    number = before[-1] + 1 if before else 0
    events.withColumnRenamed("id", "log_id").write.mode("overwrite").parquet(f"{path}/{_ROUND}{number}")
    return number
