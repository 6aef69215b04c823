"""Change-data capture as batch operators: operation codes, event rows, insert/update inference."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..constants import DEFAULT_PROFILE, FIRST_SIGHT_TTL_DAYS, LOG_OPERATIONS, STREAM_OPERATIONS, SourceProfile
from ..functions import keys as K
from ..functions.text import computed_once, let, mapped, strip_prefix
from ..session import WorkTables
from .skew import following

_ENVELOPE = (
    "struct<payload:struct<before:string,after:string,op:string,ts_ms:bigint,source:struct<table:string>>,"
    "_corrupt_record:string>"
)


def stream_operation(code: Column | str) -> Column:
    """Operation of a stream code; NULL for anything else, upper case included (CDC-1)."""
    return mapped(code, STREAM_OPERATIONS, None)


def log_operation(code: Column | str) -> Column:
    """Operation of a change-log code in any case; the job fails on anything else (CDC-2)."""
    c = F.upper(F.coalesce(F.col(code) if isinstance(code, str) else code, F.lit("")))
    failure = F.raise_error(F.concat(F.lit("unsupported operation: "), c)).cast("string")
    return mapped(c, LOG_OPERATIONS, failure)


def parse_entries(entries: DataFrame, profile: SourceProfile = DEFAULT_PROFILE) -> DataFrame:
    """Stream entries as event rows plus an ``error`` that is NULL for good ones (CDC-1, CDC-3, JSN-4).

    Empty entries and tombstones are dropped (FLT-8).  Works on batch and streaming frames alike.
    """
    filled = entries.where(F.col("value").isNotNull() & (F.col("value") != ""))

    def event(e: Column) -> Column:
        op, table = e["payload"]["op"], e["payload"]["source"]["table"]
        error = (
            F.when(e.isNull() | e["_corrupt_record"].isNotNull(), F.lit("not_json"))
            .when(op.isNull(), F.lit("no_operation"))
            .when(stream_operation(op).isNull(), F.lit("unsupported_operation"))
        )
        return F.struct(
            F.when(table != "", table).alias("_table"),
            stream_operation(op).alias("change_operation"),
            e["payload"]["ts_ms"].alias("ts_ms"),
            e["payload"]["before"].alias("before"),
            e["payload"]["after"].alias("after"),
            error.alias("error"),
        )

    parsed = computed_once(filled, ["stream_key", "msg_id", "value"], let(F.from_json("value", _ENVELOPE), event))
    table, locator = F.coalesce("_table", strip_prefix("stream_key", profile.stream_prefix)), K.stream_locator("stream_key", "msg_id")
    return parsed.select(
        K.surrogate_id(table, "msg_id", locator).alias("bronze_rdb_event_id"),
        table.alias("table_name"),
        F.col("msg_id").alias("batch_id"),
        locator.alias("s3_path"),
        F.lit(1).cast("long").alias("record_count"),
        "change_operation",
        F.timestamp_millis("ts_ms").alias("event_dts"),
        "ts_ms", "before", "after", "value", "error",
    )


def good_events(parsed: DataFrame) -> DataFrame:
    """Rows of the event table (``schemas.EVENT``) with the images; id and time come from the message, so a
    replay gives the same rows."""
    return parsed.where("error IS NULL").drop("error", "value")


def quarantined(parsed: DataFrame) -> DataFrame:
    """Messages that became no event, with the reason; they never stop the stream (CDC-4)."""
    return parsed.where("error IS NOT NULL").select("batch_id", "s3_path", "value", "error")


def row_events(
    rows: DataFrame, op: Column | str, key_parts: Sequence[str], profile: SourceProfile = DEFAULT_PROFILE, at: Column | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Event rows of polled or logged rows: batch id ``no:seq`` and its locator (KEY-9).

    With the time ``at`` of the change they are whole rows of the event table; the time is part of the id, so each
    change of a row is an event of its own.  ``keep``: columns of the rows that the events carry on.
    """
    operation = F.col(op) if isinstance(op, str) else op
    batch = K.joined(":", *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in key_parts])
    locator = K.row_locator(profile.table_name, *key_parts)
    columns = [
        F.lit(profile.table_name).alias("table_name"),
        batch.alias("batch_id"),
        locator.alias("s3_path"),
        F.lit(1).cast("long").alias("record_count"),
        operation.alias("change_operation"),
    ]
    if at is not None:
        moment = at.cast("timestamp")
        event_id = K.surrogate_id(F.lit(profile.table_name), batch, locator, operation, F.unix_micros(moment))
        columns = [event_id.alias("bronze_rdb_event_id"), *columns, moment.alias("event_dts")]
    return rows.select(*columns, *keep)


def pending_log(log: DataFrame, last_id: int = 0) -> DataFrame:
    """Change-log rows after the last id that are not processed (SRC-5)."""
    return log.where(~F.col("processed") & (F.col("id") > F.lit(last_id)))


def mark_processed(log: DataFrame, processed_ids: DataFrame) -> DataFrame:
    """The log with the given ids marked as processed (SNK-8)."""
    hit = processed_ids.select("id").distinct().withColumn("_hit", F.lit(True))
    return log.join(hit, "id", "left").withColumn(
        "processed", F.col("processed") | F.coalesce("_hit", F.lit(False))
    ).drop("_hit")


def infer_operations(
    rows: DataFrame,
    key: str,
    order: str,
    row_id: str,
    ttl_days: float | None = None,
    stateful: bool = True,
    out: str = "change_operation",
) -> DataFrame:
    """``insert`` for the first sighting of a key, ``update`` for later ones (WIN-6, CDC-6, CDC-7).

    With a lifetime, the memory of a key ends that long after the sighting that began it and the next
    row is an insert again; updates do not prolong it.  ``order`` is a timestamp, ``row_id`` unique.

    The inserts, few per key, are found by aggregation and joined back on the unique row; no task ever
    holds all rows of a hot key.
    """
    if not stateful:
        return rows.withColumn(out, F.lit("insert"))
    micros = F.unix_micros(F.col(order).cast("timestamp"))
    sight = F.struct(micros.alias("t"), F.col(row_id).alias("id"))
    if ttl_days is None:
        inserts = rows.groupBy(key).agg(F.min(sight).alias("_s")).select(key, F.col("_s.id").alias(row_id))
    else:
        ttl = int(ttl_days * 86_400_000_000)
        inserts = _anchors(rows.select(key, sight.alias("_s")), key, ttl)
        inserts = inserts.select(key, F.col("_s.id").alias(row_id))
    flagged = rows.join(inserts.withColumn("_first", F.lit(True)), [key, row_id], "left")
    return flagged.select(
        *rows.columns, F.when(F.col("_first"), F.lit("insert")).otherwise(F.lit("update")).alias(out)
    )


def _anchors(sights: DataFrame, key: str, ttl: int) -> DataFrame:
    """The sightings that begin a memory, for every key.

    A memory's end leads to the next sighting after it, the successor of the one that began it.  A key's time is cut
    into buckets of one lifetime, counted from its first sighting; each bucket holds one beginning at most.  Blocks
    of 2, 4, 8, ... buckets learn for each sighting by which they can be entered where the chain leaves them: from what
    their halves know.  A block can be entered in its first bucket, or at the first sighting after that bucket, so
    the tables halve from level to level.  Down again, what enters a block tells what enters its right half.  So
    there are as many rounds as the number of lifetimes has digits, in base 2, and no task holds a key's rows.
    """
    work = WorkTables(sights.sparkSession)
    ends = sights.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("_s").alias("_first"), F.max("_s.t").alias("_last"))
    ends = work.write(ends, "sighting-ends")
    longer = ends.where(F.col("_last") > F.col("_first.t") + ttl).select(key, F.col("_first.t").alias("_begin"))
    roots = ends.select(key, F.col("_first").alias("_s"))
    levels = _chain_levels(work, sights.join(longer, key), key, ttl)
    found = roots.join(longer.select(key), key, "left_semi").select(key, "_s", F.lit(0).cast("bigint").alias("b"))
    for k in range(len(levels) - 1, -1, -1):
        end = F.col("b") - F.col("b") % (2 << k) + (2 << k)
        step = levels[k].select(key, F.col("_s.id").alias("_id"), "nxt", "nb")
        own = found.select(key, F.col("_s.id").alias("_id"), "b").join(step, [key, "_id"])
        right = own.where(F.col("nb") < end).select(key, F.col("nxt").alias("_s"), F.col("nb").alias("b"))
        found = work.write(found.unionByName(right), "sighting-anchors")
    single = roots.join(longer.select(key), key, "left_anti")
    anchors = WorkTables(sights.sparkSession).write(single.unionByName(found.select(key, "_s")), "anchors")
    work.drop()
    return anchors


def _chain_levels(work: WorkTables, rows: DataFrame, key: str, ttl: int) -> list[DataFrame]:
    """Per level, where the chain from a sighting leaves its block of ``2 ** level`` buckets: ``nxt`` in bucket ``nb``."""
    sights = rows.select(key, "_s", "_begin", F.col("_s.t").alias("t"), F.lit(0).alias("asks"), F.col("_s.id").alias("id"))
    # A memory's end stands among the sightings, after those of the same moment; the next sighting is the successor.
    asking = sights.withColumn("t", F.col("t") + ttl).withColumn("asks", F.lit(1))
    after = following(sights.unionByName(asking), [key], ["t", "asks", "id"], F.col("asks") == 0, F.col("_s"), "nxt")
    def bucket_of(t: str) -> Column:
        return F.call_function("div", F.col(t) - F.col("_begin"), F.lit(max(ttl, 1)))

    bucket = bucket_of("_s.t")
    nodes = after.where("asks = 1").select(
        key, "_s", bucket.alias("b"), "nxt", bucket_of("nxt.t").alias("nb"))
    buckets = rows.groupBy(key, bucket.alias("b")).agg(F.min("_s").alias("_s"))
    # One row per key and lifetime.
    before = F.coalesce(F.lag("b").over(W.partitionBy(key).orderBy("b")), F.lit(0))
    firsts = buckets.select(key, F.col("_s.id").alias("_id"), before.alias("prev"))
    nodes = nodes.withColumn("_id", F.col("_s.id")).join(firsts, [key, "_id"], "left").drop("_id")
    level = work.write(nodes, "sighting-level")
    most = level.agg(F.max("b")).first()[0] or 0
    levels = [level] if most else []
    while len(levels) < most.bit_length():
        size = 1 << len(levels)
        start = F.col("b") - F.col("b") % size
        enters = level.where((F.col("b") == start) | (F.col("prev") <= start))
        on = level.select(F.col(key).alias("_key"), F.col("_s.id").alias("_from"), F.col("nxt").alias("nxt2"), F.col("nb").alias("nb2"))
        inside = F.col("nb") < start + size
        joined = enters.join(on, (F.col(key) == F.col("_key")) & inside & (F.col("nxt.id") == F.col("_from")), "left")
        level = work.write(joined.select(
            key, "_s", "b", F.when(inside, F.col("nxt2")).otherwise(F.col("nxt")).alias("nxt"),
            F.when(inside, F.col("nb2")).otherwise(F.col("nb")).alias("nb"), "prev"), "sighting-level")
        levels.append(level)
    return levels


def snapshot_then_changes(snapshot: DataFrame, changes: DataFrame, include_tables: Sequence[str] | None = None):
    """Snapshot rows as operation ``r`` followed by the changes, of the captured tables only (SRC-9)."""
    both = snapshot.withColumn("op", F.lit("r")).unionByName(changes)
    return both if include_tables is None else both.where(F.col("table_name").isin(*include_tables))


__all__ = [
    "FIRST_SIGHT_TTL_DAYS", "good_events", "infer_operations", "log_operation", "mark_processed", "parse_entries",
    "pending_log", "quarantined", "row_events", "snapshot_then_changes", "stream_operation",
]
