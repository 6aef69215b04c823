"""Queries over change capture, batch and streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import FIRST_SIGHT_TTL_DAYS, SourceProfile
from ..functions import keys as K
from ..operators import cdc as C
from ..operators import stats
from ..operators import tables as T
from ..session import spread_small, stream_session, work_path
from ..sources import change_log, polling, records
from ..streaming import changes as CH
from ..streaming import sightings as SI
from .registry import query, table

PROFILE = SourceProfile(stream_prefix="src.app.")

# One stream entry per event.  Some name their table in the envelope, some only by the stream key; some are
# tombstones, not JSON, without operation or with an unknown one.
_OP_SQL = "CASE event_type WHEN 'click' THEN 'c' WHEN 'view' THEN 'u' WHEN 'purchase' THEN 'd' WHEN 'signup' THEN 'r' ELSE 'C' END"
_ENTRIES_SQL = f"""entries AS (SELECT event_id, user_id, {_OP_SQL} AS op,
  CASE WHEN event_id % 10 = 3 THEN 'other.' || event_type ELSE 'src.app.' || event_type END AS stream_key,
  CAST(event_id AS VARCHAR) || '-0' AS msg_id,
  CASE event_id % 10 WHEN 0 THEN 'tombstone' WHEN 1 THEN 'not_json' WHEN 2 THEN 'no_operation' WHEN 4 THEN 'named' ELSE 'plain' END AS kind
  FROM events),
parsed AS (SELECT *, CASE WHEN kind = 'named' THEN 'users' WHEN starts_with(stream_key, 'src.app.') THEN substr(stream_key, 9)
    ELSE stream_key END AS table_name,
  'cdc://' || stream_key || '/' || msg_id AS s3_path,
  CASE op WHEN 'c' THEN 'insert' WHEN 'u' THEN 'update' WHEN 'd' THEN 'delete' WHEN 'r' THEN 'snapshot' END AS change_operation,
  CASE WHEN kind IN ('not_json', 'no_operation') THEN kind WHEN op = 'C' THEN 'unsupported_operation' END AS error
  FROM entries WHERE kind <> 'tombstone')"""


def entries(spark, d):
    event = F.col("event_type")
    op = (
        F.when(event == "click", "c").when(event == "view", "u").when(event == "purchase", "d")
        .when(event == "signup", "r").otherwise("C")
    )
    kind = F.col("event_id") % 10
    row = F.struct(F.col("event_id").alias("id"), "user_id")
    name = F.when(kind == 4, F.lit("users")).when(kind == 5, F.lit(""))
    envelope = F.struct(
        F.struct(
            F.when(kind != 2, op).alias("op"), F.when(op != "d", row).alias("after"), F.when(op == "d", row).alias("before"),
            F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), F.struct(name.alias("table")).alias("source"),
        ).alias("payload")
    )
    value = F.when(kind == 0, F.lit("")).when(kind == 1, F.lit("{not json")).otherwise(F.to_json(envelope))
    return spread_small(table(spark, d, "events")).select(
        F.concat(F.when(kind == 3, F.lit("other.")).otherwise(F.lit("src.app.")), event).alias("stream_key"),
        F.concat(F.col("event_id").cast("string"), F.lit("-0")).alias("msg_id"),
        value.alias("value"),
    )


_GOOD = "SELECT table_name, msg_id AS batch_id, s3_path, CAST(1 AS BIGINT) AS record_count, change_operation FROM parsed WHERE error IS NULL"
_EVENT_COLUMNS = ("table_name", "batch_id", "s3_path", "record_count", "change_operation")


@query("cdc_normalize", f"WITH {_ENTRIES_SQL} {_GOOD}")
def cdc_normalize(spark, d):
    """CDC-1, CDC-3, JSN-4, KEY-9, FLT-8, STR-13."""
    return C.good_events(C.parse_entries(entries(spark, d), PROFILE)).select(*_EVENT_COLUMNS)


@query(
    "cdc_counts",
    f"WITH {_ENTRIES_SQL} SELECT change_operation, count(*) AS events FROM parsed WHERE error IS NULL GROUP BY 1",
)
def cdc_counts(spark, d):
    """AGG-8."""
    return stats.operation_counts(C.good_events(C.parse_entries(entries(spark, d), PROFILE)))


_QUARANTINE = f"WITH {_ENTRIES_SQL} SELECT msg_id AS batch_id, s3_path, error FROM parsed WHERE error IS NOT NULL"


@query("cdc_quarantine", _QUARANTINE)
def cdc_quarantine(spark, d):
    """CDC-4."""
    return C.quarantined(C.parse_entries(entries(spark, d), PROFILE)).select("batch_id", "s3_path", "error")


@query(
    "poll_two_rounds",
    """WITH a AS (SELECT * FROM orders WHERE o_orderdate < timestamp '1999-01-01'), m AS (SELECT max(o_orderdate) AS mark FROM a)
SELECT 1 AS round, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM a
UNION ALL SELECT 2, count(*), sum(o_orderkey)::BIGINT FROM orders, m WHERE o_orderdate > coalesce(mark, timestamp '0001-01-01')
UNION ALL SELECT 3, 0, NULL""",
)
def poll_two_rounds(spark, d):
    """SRC-4: the source as it was, as it is now, and again; the mark is stored between the polls."""
    path, orders = work_path(spark, "mark"), table(spark, d, "orders")
    rounds = None
    for i, source in enumerate((orders.where("o_orderdate < timestamp '1999-01-01'"), orders, orders), 1):
        rows, commit = polling.poll_round(source, "o_orderdate", path)
        seen = rows.agg(F.lit(i).alias("round"), F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))
        commit()
        rounds = seen if rounds is None else rounds.unionByName(seen)
    return rounds


@query(
    "poll_incremental",
    """SELECT 'rows' AS part, count(*) AS n, strftime(max(o_orderdate), '%Y-%m-%d') AS mark FROM orders WHERE o_orderdate > timestamp '1998-06-01'
UNION ALL SELECT 'first', count(*), strftime(max(o_orderdate), '%Y-%m-%d') FROM orders
UNION ALL SELECT 'none', 0, '2100-01-01'""",
)
def poll_incremental(spark, d):
    """SRC-4: a later poll, a first poll, and one that finds nothing and keeps its mark."""
    orders = table(spark, d, "orders")
    parts = []
    for name, last in (("rows", "1998-06-01"), ("first", None), ("none", "2100-01-01")):
        rows = polling.poll(orders, "o_orderdate", last)
        mark = polling.high_water_mark(rows, "o_orderdate", last)
        counted = rows.agg(F.count("*").alias("n"))
        one = counted.select(F.lit(name).alias("part"), "n", mark.scalar().alias("mark"))
        parts.append(one.withColumn("mark", F.date_format("mark", "yyyy-MM-dd")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_POLL_KEY = "sha256(user_id || '|' || event_type)"


def _sightings(spark, d):
    return table(spark, d, "events").select(
        "event_id", "ts", "user_id", "event_type", K.poll_key("user_id", "event_type").alias("row_key")
    )


@query(
    "poll_infer_op",
    f"""SELECT event_id, {_POLL_KEY} AS row_key, CASE WHEN row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1
  THEN 'insert' ELSE 'update' END AS change_operation, 'cdc://report_history/' || user_id || ':' || event_type AS s3_path FROM events""",
)
def poll_infer_op(spark, d):
    """WIN-6, KEY-6, KEY-9."""
    out = C.infer_operations(_sightings(spark, d), "row_key", "ts", "event_id")
    return out.select(
        "event_id", "row_key", "change_operation", K.row_locator("report_history", "user_id", "event_type").alias("s3_path")
    )


_TTL_SQL = f"""WITH RECURSIVE k AS (SELECT user_id, event_type, event_id, ts FROM events),
a(user_id, event_type, ts) AS (
  SELECT user_id, event_type, min(ts) FROM k GROUP BY ALL
  UNION ALL
  SELECT x.user_id, x.event_type, x.ts FROM (
    SELECT a.user_id, a.event_type, (SELECT min(k.ts) FROM k WHERE k.user_id = a.user_id AND k.event_type = a.event_type
      AND k.ts > a.ts + INTERVAL {FIRST_SIGHT_TTL_DAYS} DAY) AS ts FROM a) x WHERE x.ts IS NOT NULL),
f AS (SELECT a.user_id, a.event_type, min(k.event_id) AS event_id FROM a JOIN k USING (user_id, event_type, ts) GROUP BY a.user_id, a.event_type, a.ts)
SELECT event_id, {_POLL_KEY} AS row_key, CASE WHEN event_id IN (SELECT event_id FROM f) THEN 'insert' ELSE 'update' END AS change_operation FROM k"""


@query("poll_infer_op_ttl", _TTL_SQL)
def poll_infer_op_ttl(spark, d):
    """WIN-6 with the lifetime that starts at the first sighting."""
    out = C.infer_operations(_sightings(spark, d), "row_key", "ts", "event_id", ttl_days=FIRST_SIGHT_TTL_DAYS)
    return out.select("event_id", "row_key", "change_operation")


@query("poll_stateless", f"SELECT event_id, {_POLL_KEY} AS row_key, 'insert' AS change_operation FROM events")
def poll_stateless(spark, d):
    """CDC-7."""
    out = C.infer_operations(_sightings(spark, d), "row_key", "ts", "event_id", stateful=False)
    return out.select("event_id", "row_key", "change_operation")


_LOG_SQL = """log AS (SELECT event_id AS id, user_id, CASE event_type WHEN 'click' THEN 'INSERT' WHEN 'view' THEN 'Update' WHEN 'purchase' THEN 'delete'
  ELSE 'UPDATE' END AS operation, event_id % 3 = 0 AS processed FROM events)"""


def _log(spark, d):
    event = F.col("event_type")
    op = F.when(event == "click", "INSERT").when(event == "view", "Update").when(event == "purchase", "delete").otherwise("UPDATE")
    return table(spark, d, "events").select(
        F.col("event_id").alias("id"), op.alias("operation"), F.col("user_id").alias("pilot_problem_no"),
        F.lit(1).alias("reform_numseq"), F.col("ts").alias("changed_at"), (F.col("event_id") % 3 == 0).alias("processed"),
    )


@query(
    "changelog_pending",
    f"""WITH {_LOG_SQL} SELECT user_id || ':1' AS batch_id, 'cdc://report_history/' || user_id || ':1' AS s3_path,
  lower(operation) AS change_operation, count(*) AS n FROM log WHERE NOT processed GROUP BY ALL""",
)
def changelog_pending(spark, d):
    """SRC-5, CDC-2, STR-12, KEY-9."""
    pending = C.pending_log(_log(spark, d), last_id=0)
    events = C.row_events(pending, C.log_operation("operation"), ["pilot_problem_no", "reform_numseq"])
    return events.groupBy("batch_id", "s3_path", "change_operation").agg(F.count("*").alias("n"))


@query(
    "changelog_mark",
    f"WITH {_LOG_SQL} SELECT id, processed OR id IN (SELECT doc_id FROM labels) AS processed FROM log",
)
def changelog_mark(spark, d):
    """SNK-8."""
    done = table(spark, d, "labels").select(F.col("doc_id").alias("id"))
    return C.mark_processed(_log(spark, d), done).select("id", "processed")


@query(
    "changelog_two_rounds",
    f"""WITH {_LOG_SQL}, h AS (SELECT (max(id) + min(id)) // 2 AS half FROM log)
SELECT id AS log_id, CASE WHEN id <= half AND id % 7 <> 0 THEN 0 ELSE 1 END AS round, user_id || ':1' AS batch_id, lower(operation) AS change_operation
FROM log, h WHERE NOT processed""",
)
def changelog_two_rounds(spark, d):
    """SNK-8, SRC-5: half the log, then all of it; ids that came late are read in the second round, the others once."""
    path, log = work_path(spark, "log-rounds"), _log(spark, d)
    ends = log.agg(F.min("id").alias("a"), F.max("id").alias("b")).first()
    key = ["pilot_problem_no", "reform_numseq"]
    change_log.run_round(spark, log.where((F.col("id") <= (ends.a + ends.b) // 2) & (F.col("id") % 7 != 0)), path, key)
    change_log.run_round(spark, log, path, key)
    change_log.run_round(spark, log, path, key)  # nothing new
    return change_log.committed_events(spark, path).select("log_id", "round", "batch_id", "change_operation")


@query(
    "apply_changes",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events)
SELECT user_id, event_type, event_id, value FROM r WHERE rn = 1 AND event_id % 3 <> 2""",
)
def apply_changes(spark, d):
    """CDC-10."""
    op = F.when(F.col("event_id") % 3 == 2, "delete").when(F.col("event_id") % 3 == 1, "update").otherwise("insert")
    changes = table(spark, d, "events").drop("props").withColumn("change_operation", op)
    out = T.current_state(changes, ["user_id", "event_type"], ["ts", "event_id"])
    return out.select("user_id", "event_type", "event_id", "value")


@query(
    "snapshot_plus_changes",
    """SELECT 'r' AS op, 'orders' AS table_name, o_orderkey AS id FROM orders
UNION ALL SELECT CASE event_type WHEN 'click' THEN 'c' WHEN 'view' THEN 'u' ELSE 'd' END, 'orders', event_id FROM events WHERE event_type <> 'error'""",
)
def snapshot_plus_changes(spark, d):
    """SRC-9: changes of a table that is not captured are left out."""
    event = F.col("event_type")
    changes = table(spark, d, "events").select(
        F.when(event == "error", "bronze_events").otherwise("orders").alias("table_name"), F.col("event_id").alias("id"),
        F.when(event == "click", "c").when(event == "view", "u").otherwise("d").alias("op"),
    )
    snapshot = table(spark, d, "orders").select(F.lit("orders").alias("table_name"), F.col("o_orderkey").alias("id"))
    return C.snapshot_then_changes(snapshot, changes, ["orders"]).select("op", "table_name", "id")


@query(
    "hash_bridge",
    """WITH j AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN props WHEN 1 THEN '{}'
    WHEN 2 THEN '{"source_name": "' || event_type || '", "primary_key": ' || user_id || '}' ELSE '' END AS js,
  event_id % 6 AS k, event_type, user_id FROM events),
h AS (SELECT *, CASE WHEN k IN (3, 5) THEN NULL WHEN k = 2 THEN sha256(event_type || '||' || user_id) ELSE sha256('unknown||') END AS row_hash FROM j)
SELECT event_id, row_hash, CASE WHEN k IN (3, 5) THEN NULL WHEN k = 1 THEN '{"row_hash": "' || row_hash || '"}'
  WHEN k = 4 THEN '{"a":' || user_id || ',"row_hash":"' || row_hash || '"}'
  ELSE substr(js, 1, length(js) - 1) || ', "row_hash": "' || row_hash || '"}' END AS record,
  CASE WHEN k IN (3, 5) THEN 'invalid JSON input' END AS error FROM h""",
)
def hash_bridge(spark, d):
    """KEY-10, UDF-4; some records have a row hash already, some have text after their end."""
    kind = F.col("event_id") % 6
    named = F.concat(
        F.lit('{"source_name": "'), "event_type", F.lit('", "primary_key": '), F.col("user_id").cast("string"), F.lit("}")
    )
    js = F.when(kind == 0, F.col("props")).when(kind == 1, F.lit("{}")).when(kind == 2, named).when(kind == 3, F.lit("{bad"))
    js = js.when(kind == 4, F.concat(F.lit('{"row_hash": "old", "a": '), F.col("user_id").cast("string"), F.lit("}")))
    js = js.otherwise(F.concat("props", F.lit(" trailing")))
    out = records.hash_records(table(spark, d, "events").select("event_id", js.alias("js")), "js")
    return out.select("event_id", "row_hash", "record", "error")


@query(
    "json_records",
    """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE event_id % 3 <> 2
UNION ALL SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) FROM events WHERE event_id % 3 = 1""",
)
def json_records(spark, d):
    """SRC-8: one object, a list of two, or nothing."""
    kind = F.col("event_id") % 3
    twice = F.concat(F.lit("["), "props", F.lit(","), "props", F.lit("]"))
    js = F.when(kind == 0, F.col("props")).when(kind == 1, twice).otherwise(F.lit(" "))
    return records.parse_json_records(table(spark, d, "events").select("event_id", js.alias("js")), "js", "k:bigint")


def _stream(spark, d, files: int = 4):
    """The entries as JSON files and a stream over them, one file per trigger."""
    folder = work_path(spark, "entries")
    entries(spark, d).repartition(files).write.json(folder)
    return CH.file_entries(spark, folder, max_files=1)


@query("stream_cdc", f"WITH {_ENTRIES_SQL} {_GOOD}")
def stream_cdc(spark, d):
    """SRC-6, SRC-7, CDC-3..5 as a stream over all entries."""
    out = work_path(spark, "cdc")
    CH.write_events(_stream(spark, d), f"{out}/events", f"{out}/bad", f"{out}/state", profile=PROFILE).awaitTermination()
    return spark.read.parquet(f"{out}/events").select(*_EVENT_COLUMNS)


@query("stream_quarantine", _QUARANTINE)
def stream_quarantine(spark, d):
    """CDC-4 as a stream."""
    out = work_path(spark, "cdc")
    CH.write_events(_stream(spark, d), f"{out}/events", f"{out}/bad", f"{out}/state", profile=PROFILE).awaitTermination()
    return spark.read.parquet(f"{out}/bad").select("batch_id", "s3_path", "error")


@query(
    "stream_stage_counts",
    """SELECT 'structuring' AS stage, count(*) AS docs_out FROM documents UNION ALL SELECT 'masking', count(*) FROM labels
UNION ALL SELECT 'chunking', count(*) FROM conversations UNION ALL SELECT 'enrichment', count(*) FROM pages UNION ALL SELECT 'mapping', 0""",
)
def stream_stage_counts(spark, d):
    """CDC-9: live counts of all stages from one stream over their tables, a third of each one's files per trigger; one stage is still empty."""
    out, stages, files = work_path(spark, "stages"), {}, {}
    for stage, name in (("structuring", "documents"), ("masking", "labels"), ("chunking", "conversations"), ("enrichment", "pages")):
        rows = table(spark, d, name)
        # Tables of many parts are written part by part, so no task takes more than one of them.
        parts = rows.rdd.getNumPartitions()
        (rows if parts >= 3 else rows.repartition(3)).write.parquet(f"{out}/{stage}")
        files[stage] = -(-max(parts, 3) // 3)
        stages[stage] = (f"{out}/{stage}", rows.schema)
    empty = table(spark, d, "documents").limit(0)
    empty.write.parquet(f"{out}/mapping")
    stages["mapping"] = (f"{out}/mapping", empty.schema)
    counts = CH.stage_rows(stream_session(spark), stages, files)
    CH.write_stage_counts(counts, f"{out}/counts", f"{out}/state").awaitTermination()
    return CH.latest_stage_counts(spark, f"{out}/counts", list(stages))


@query(
    "stream_counts",
    f"WITH {_ENTRIES_SQL} SELECT change_operation, count(*) AS events FROM parsed WHERE error IS NULL GROUP BY 1",
)
def stream_counts(spark, d):
    """CDC-9, AGG-8 as a stream."""
    out = work_path(spark, "counts")
    stream = _stream(stream_session(spark), d)
    CH.write_counts(stream, f"{out}/counts", f"{out}/state", profile=PROFILE).awaitTermination()
    return CH.latest_counts(spark, f"{out}/counts").select("change_operation", "events")


@query("stream_infer_op_ttl", _TTL_SQL)
def stream_infer_op_ttl(spark, d):
    """CDC-6 as a stream: a third of the time after the other, one per trigger."""
    rows = table(spark, d, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), K.poll_key("user_id", "event_type").alias("row_key")
    )
    out = work_path(spark, "sightings")
    span = rows.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    third = (span.b - span.a) / 3
    own = stream_session(spark)
    for i in range(3):
        part = rows.where((F.col("ts") >= span.a + i * third) | F.lit(i == 0))
        part = part.where((F.col("ts") < span.a + (i + 1) * third) | F.lit(i == 2))
        part.write.mode("append").parquet(f"{out}/in")
        # The stream goes on from its checkpoint with the files that came, so later rows come in later triggers.
        result = SI.infer_operations_stream(own.readStream.schema(rows.schema).parquet(f"{out}/in"), "row_key", "ts", "event_id")
        sink = result.writeStream.format("parquet").option("path", f"{out}/out")
        sink.option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/out").select("event_id", "row_key", "change_operation")
