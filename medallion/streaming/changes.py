"""Change stream -> Bronze events with quarantine, live counts and downstream calls."""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..constants import DEFAULT_PROFILE, SourceProfile
from ..operators.cdc import good_events, parse_entries, quarantined
from ..operators.stats import operation_counts
from ..schemas import STREAM_ENTRY

TRIGGER = "5 seconds"
LOG = logging.getLogger(__name__)


def file_entries(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Entries from JSON files; a glob also finds folders of streams that appear later (SRC-6, SRC-7)."""
    reader = spark.readStream.schema(STREAM_ENTRY)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(path)


def kafka_entries(
    spark: SparkSession, servers: str, profile: SourceProfile = DEFAULT_PROFILE, per_read: int | None = None, **options
) -> DataFrame:
    """Entries of all topics with the prefix, new topics included, from their start (needs the Kafka package).

    ``per_read`` limits the messages of a micro-batch; without it a stream reads all there is.
    """
    raw = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribePattern", profile.stream_prefix.replace(".", r"\.") + ".*")
        .option("startingOffsets", "earliest")
        .options(**options | ({"maxOffsetsPerTrigger": per_read} if per_read else {}))
        .load()
    )
    return raw.select(
        F.col("topic").alias("stream_key"),
        F.concat_ws("-", "partition", "offset").alias("msg_id"),
        F.col("value").cast("string").alias("value"),
    )


def _start(writer, checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=TRIGGER)
    return writer.start()


def write_events(
    entries: DataFrame,
    events_path: str,
    quarantine_path: str,
    checkpoint: str,
    on_batch: Callable[[DataFrame, int], None] | None = None,
    available_now: bool = True,
    profile: SourceProfile = DEFAULT_PROFILE,
) -> StreamingQuery:
    """Good entries to the event table, bad ones to quarantine; bad data never stops the query (CDC-3, CDC-4).

    Every micro-batch writes its own folder and overwrites it on a replay, so a restart adds nothing
    twice.  ``on_batch`` gets the written events, and its failure does not undo them (CDC-5).
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        parsed = parse_entries(batch, profile).persist()  # read and parsed once for both writes
        target = f"{events_path}/stream_batch={batch_id}"
        good_events(parsed).write.mode("overwrite").parquet(target)
        quarantined(parsed).write.mode("overwrite").parquet(f"{quarantine_path}/stream_batch={batch_id}")
        parsed.unpersist()
        if on_batch is not None:
            try:
                on_batch(batch.sparkSession.read.parquet(target), batch_id)
            except Exception as error:  # the event rows stay
                LOG.warning("downstream call failed for batch %s: %s", batch_id, error)

    return _start(entries.writeStream.foreachBatch(write), checkpoint, available_now)


def write_counts(
    entries: DataFrame, path: str, checkpoint: str, available_now: bool = True, profile: SourceProfile = DEFAULT_PROFILE
) -> StreamingQuery:
    """Live counts per operation, the whole result after every trigger (CDC-9, AGG-8).

    The result has one row per operation.
    """
    return _write_complete(operation_counts(good_events(parse_entries(entries, profile))), path, checkpoint, available_now)


def stage_rows(spark: SparkSession, stages: Mapping[str, tuple[str, StructType]], max_files: int | Mapping[str, int] | None = None) -> DataFrame:
    """One stream over the tables of all stages, a path and schema each: a row ``stage`` for each of their rows.

    No column of a table is read but what counting needs.  A table that is still empty must have its folder.
    ``max_files`` per trigger holds for each table, or is given by stage.
    """
    parts = []
    for stage, (path, schema) in stages.items():
        reader = spark.readStream.schema(schema)
        files = max_files.get(stage) if isinstance(max_files, Mapping) else max_files
        if files:
            reader = reader.option("maxFilesPerTrigger", files)
        parts.append(reader.parquet(path).select(F.lit(stage).alias("stage")))
    return reduce(DataFrame.unionByName, parts)


def write_stage_counts(rows: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Live counts per stage, the whole result after every trigger (CDC-9).

    The state is one number per stage, and tasks count before they shuffle, so a stage of any size adds a row per task.
    """
    return _write_complete(rows.groupBy("stage").agg(F.count("*").alias("docs_out")), path, checkpoint, available_now)


def latest_stage_counts(spark: SparkSession, path: str, stages: Sequence[str]) -> DataFrame:
    """The newest counts of all stages, 0 for those without rows."""
    names = spark.createDataFrame([(s,) for s in stages], "stage string")
    counts = latest_counts(spark, path).withColumnRenamed("stage", "_stage")
    joined = names.join(F.broadcast(counts), F.col("stage") == F.col("_stage"), "left")  # a row per stage on both sides
    return joined.select("stage", F.coalesce("docs_out", F.lit(0)).alias("docs_out"))


def _write_complete(counted: DataFrame, path: str, checkpoint: str, available_now: bool) -> StreamingQuery:
    """The newest ``stream_batch`` folder is the current result; those before the last two go."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.coalesce(1).write.mode("overwrite").parquet(f"{path}/stream_batch={batch_id:012d}")
        spark = batch.sparkSession
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for entry in files.listStatus(folder):
            name = entry.getPath().getName()
            if name.startswith("stream_batch=") and int(name.partition("=")[2]) < batch_id - 1:
                files.delete(entry.getPath(), True)

    return _start(counted.writeStream.outputMode("complete").foreachBatch(write), checkpoint, available_now)


def latest_counts(spark: SparkSession, path: str) -> DataFrame:
    """The counts of the newest trigger."""
    all_counts = spark.read.parquet(path)
    newest = all_counts.agg(F.max("stream_batch")).scalar()
    return all_counts.where(F.col("stream_batch") == newest).drop("stream_batch")
