"""Change capture in batch and as streams."""

from __future__ import annotations

import json
import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from medallion.constants import SourceProfile
from medallion.operators import cdc
from medallion.session import work_path
from medallion.sources import batches, change_log, polling, records
from medallion.streaming import changes, sightings
from tests.conftest import rows

PROFILE = SourceProfile(stream_prefix="src.app.")


def envelope(op, table="t1", **extra):
    source = {} if table is None else {"source": {"table": table}}
    return json.dumps({"schema": {}, "payload": {"before": None, "after": {"a": 1}, "op": op, "ts_ms": 5, **source, **extra}})


ENTRIES = [
    ("src.app.t1", "1-0", envelope("c")),
    ("src.app.t1", "2-0", envelope("u", table="other")),
    ("src.app.t2", "3-0", envelope("d", table="")),
    ("src.app.t2", "4-0", envelope("r", table=None)),
    ("foreign", "5-0", envelope("c", table=None)),
    ("src.app.t1", "6-0", ""),
    ("src.app.t1", "7-0", None),
    ("src.app.t1", "8-0", "not json"),
    ("src.app.t1", "9-0", "{}"),
    ("src.app.t1", "10-0", envelope("X")),
    ("src.app.t1", "11-0", envelope("C")),
    ("src.app.t1", "12-0", envelope("")),
    ("src.app.t1", "13-0", "[1, 2]"),
    ("src.app.t1", "14-0", '{"payload": 3}'),
]
GOOD = [
    ("foreign", "5-0", "cdc://foreign/5-0", "insert"),
    ("other", "2-0", "cdc://src.app.t1/2-0", "update"),
    ("t1", "1-0", "cdc://src.app.t1/1-0", "insert"),
    ("t2", "3-0", "cdc://src.app.t2/3-0", "delete"),
    ("t2", "4-0", "cdc://src.app.t2/4-0", "snapshot"),
]
BAD = {"8-0": "not_json", "10-0": "unsupported_operation", "11-0": "unsupported_operation", "12-0": "unsupported_operation", "9-0": "no_operation"}


def entries(spark):
    return spark.createDataFrame(ENTRIES, "stream_key string, msg_id string, value string")


def test_entries(spark):
    parsed = cdc.parse_entries(entries(spark), PROFILE)
    assert rows(cdc.good_events(parsed).select("table_name", "batch_id", "s3_path", "change_operation")) == GOOD
    bad = {r.batch_id: r.error for r in cdc.quarantined(parsed).collect()}
    assert {k: bad[k] for k in BAD} == BAD and set(bad) == set(BAD) | {"13-0", "14-0"}


def test_log_operation(spark):
    df = spark.createDataFrame([("INSERT",), ("update",), ("Delete",)], "o string")
    assert [r[0] for r in df.select(cdc.log_operation("o")).collect()] == ["insert", "update", "delete"]
    with pytest.raises(Exception, match="unsupported operation"):
        spark.createDataFrame([("MERGE",)], "o string").select(cdc.log_operation("o")).collect()


def _python_rule(events, ttl):
    seen, out = {}, {}
    for key, ts, i in sorted(events, key=lambda e: (e[1], e[2])):
        if key not in seen or (ttl is not None and ts > seen[key] + ttl):
            seen[key] = ts
            out[i] = "insert"
        else:
            out[i] = "update"
    return out


def _events(n=400):
    rng = random.Random(2)
    start = datetime(2026, 1, 1)
    return [("hot" if i % 3 else f"k{i % 9}", start + timedelta(hours=rng.randint(0, 24 * 60)), i) for i in range(n)]


def test_infer_days(spark):
    start = datetime(2026, 1, 1)
    data = [("a", start + timedelta(days=d), i) for i, d in enumerate([0, 2, 7.5, 8])]
    df = spark.createDataFrame(data, "k string, ts timestamp, id int")
    got = [r.change_operation for r in cdc.infer_operations(df, "k", "ts", "id", ttl_days=7).orderBy("id").collect()]
    assert got == ["insert", "update", "insert", "update"]


@pytest.mark.parametrize("ttl", [None, 7, 0.3])
@pytest.mark.parametrize("spread", [1, 40])
def test_infer_matches_rule(spark, ttl, spread):
    """Dense keys, and keys whose lifetimes are mostly empty; a chain of up to 200 lifetimes."""
    begin = datetime(2026, 1, 1)
    data = [(k, begin + (t - begin) * spread, i) for k, t, i in _events()]
    df = spark.createDataFrame(data, "k string, ts timestamp, id int")
    out = cdc.infer_operations(df, "k", "ts", "id", ttl_days=ttl)
    assert {r.id: r.change_operation for r in out.collect()} == _python_rule(data, None if ttl is None else timedelta(days=ttl))


def test_lifetimes_take_few_rounds(spark, monkeypatch):
    """Rounds grow with the digits of the number of lifetimes, and each level holds about half the rows of the one below."""
    levels = []
    original = cdc._chain_levels
    monkeypatch.setattr(cdc, "_chain_levels", lambda *a: levels.extend(original(*a)) or levels)
    counted = []
    drop = cdc.WorkTables.drop
    monkeypatch.setattr(cdc.WorkTables, "drop", lambda self, keep=0: (counted.extend(x.count() for x in levels), drop(self, keep)))
    df = spark.range(3000).selectExpr("'k' AS k", "timestamp_micros(id * 3600000000) AS ts", "id")
    got = cdc.infer_operations(df, "k", "ts", "id", ttl_days=10 / 24)
    want = [i for i in range(0, 3000, 11)]
    assert sorted(r.id for r in got.where("change_operation = 'insert'").collect()) == want
    assert len(counted) == (2999 // 10).bit_length() and counted[0] == 3000 and all(b <= 0.6 * a + 2 for a, b in zip(counted[:4], counted[1:5]))


def test_stateless(spark):
    df = spark.createDataFrame(_events(5), "k string, ts timestamp, id int")
    assert {r.change_operation for r in cdc.infer_operations(df, "k", "ts", "id", stateful=False).collect()} == {"insert"}


def test_stream_equals_rule(spark):
    data = sorted(_events(120), key=lambda e: e[1])
    root = work_path(spark, "t")
    for part in range(3):
        spark.createDataFrame(data[part * 40 : part * 40 + 40], "k string, ts timestamp, id int").coalesce(1).write.mode("append").parquet(f"{root}/in")
    stream = spark.readStream.schema("k string, ts timestamp, id int").parquet(f"{root}/in")
    out = sightings.infer_operations_stream(stream, "k", "ts", "id")
    out.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/c").trigger(availableNow=True).start().awaitTermination()
    got = {r.id: r.change_operation for r in spark.read.parquet(f"{root}/out").collect()}
    assert got == _python_rule(data, timedelta(days=7))


def test_change_stream_with_restart_and_failing_downstream(spark):
    root = work_path(spark, "t")
    entries(spark).coalesce(1).write.json(f"{root}/in")
    calls = []

    def downstream(events, batch_id):
        calls.append(events.count())
        raise RuntimeError("not reachable")

    def run():
        stream = changes.file_entries(spark, f"{root}/in")
        changes.write_events(stream, f"{root}/ev", f"{root}/bad", f"{root}/c", downstream, profile=PROFILE).awaitTermination()

    run()
    run()
    entries(spark).where("msg_id = '1-0'").withColumn("msg_id", F.lit("15-0")).coalesce(1).write.mode("append").json(f"{root}/in")
    run()
    assert spark.read.parquet(f"{root}/ev").count() == len(GOOD) + 1
    assert spark.read.parquet(f"{root}/bad").count() == 7
    assert calls == [len(GOOD), 1]


def test_poll(spark):
    df = spark.createDataFrame([(1, datetime(2026, 1, 1)), (2, datetime(2026, 1, 3))], "id int, upd timestamp")
    assert polling.poll(df, "upd").count() == 2
    assert [r.id for r in polling.poll(df, "upd", "2026-01-01").collect()] == [2]
    nothing = polling.poll(df, "upd", "2026-02-01")
    assert polling.high_water_mark(nothing, "upd", "2026-02-01").first()[0] == datetime(2026, 2, 1)


def test_json_records_fail_fast(spark):
    df = spark.createDataFrame([('{"k":1}',), ('[{"k":2},{"k":3}]',), ("",)], "j string")
    assert rows(records.parse_json_records(df, "j", "k:int")) == [(1,), (2,), (3,)]
    with pytest.raises(Exception):
        records.parse_json_records(spark.createDataFrame([("{bad",)], "j string"), "j", "k:int").collect()


def test_json_files(spark, tmp_path):
    from medallion.schemas import T

    schema = T.StructType([T.StructField("k", T.IntegerType())])
    (tmp_path / "one.json").write_text('{"k": 1}')
    (tmp_path / "list.json").write_text('[{"k": 2},\n {"k": 3}]')
    (tmp_path / "empty.json").write_text("")
    assert rows(records.read_json_records(spark, str(tmp_path), schema)) == [(1,), (2,), (3,)]
    (tmp_path / "bad.json").write_text("{bad")
    with pytest.raises(Exception):
        records.read_json_records(spark, str(tmp_path), schema).collect()


def test_hash_records(spark):
    from medallion.functions.keys import hub_hash

    df = spark.createDataFrame([('{"source_name":"s","primary_key":5,"x":1}',), ("{}",), ("bad",)], "j string")
    got = records.hash_records(df, "j").collect()
    expected = spark.range(1).select(hub_hash("s", F.lit("5")), hub_hash("unknown", F.lit(""))).first()
    assert [r.row_hash for r in got] == [expected[0], expected[1], None]
    assert json.loads(got[0].record) == {"source_name": "s", "primary_key": 5, "x": 1, "row_hash": expected[0]}
    assert json.loads(got[1].record) == {"row_hash": expected[1]}
    assert got[2].error == "invalid JSON input"
    odd = spark.createDataFrame([('{"row_hash":"old","a":[1,{"b":null}]}',), ('{"a":1} trailing',), ('{"a":1},{"b":2}',), ('{"x":{"row_hash":1}} ',), (None,)], "j string")
    got = records.hash_records(odd, "j").collect()
    assert json.loads(got[0].record) == {"a": [1, {"b": None}], "row_hash": expected[1]} and got[0].record.count("row_hash") == 1
    assert [r.error for r in got] == [None, "invalid JSON input", "invalid JSON input", None, "invalid JSON input"]
    assert json.loads(got[3].record) == {"x": {"row_hash": 1}, "row_hash": expected[1]}


def test_batch_overwrites_only_itself(spark):
    root = work_path(spark, "t")
    schema = "k int"
    batches.write_batch(spark.createDataFrame([(1,), (2,)], schema), root, "2026-01-01")
    batches.write_batch(spark.createDataFrame([(3,)], schema), root, "2026-01-02")
    batches.write_batch(spark.createDataFrame([(4,)], schema), root, "2026-01-01")
    typed = spark.createDataFrame([], schema).schema
    assert rows(batches.read_batch(spark, root, typed)) == [(3, "2026-01-02"), (4, "2026-01-01")]
    assert rows(batches.read_batch(spark, root, typed, "2026-01-02")) == [(3, "2026-01-02")]


def test_mark_is_kept_between_polls(spark):
    from medallion.sources import polling

    path = work_path(spark, "mark")
    seen = []
    for source in ([1, 2], [1, 2, 5], [1, 2, 5], [1, 2, 5, 9]):
        got, commit = polling.poll_round(spark.createDataFrame([(v,) for v in source], "v int"), "v", path)
        seen.append(sorted(r.v for r in got.collect()))
        if source != [1, 2, 5, 9]:
            commit()
    assert seen == [[1, 2], [5], [], [9]] and polling.stored_mark(spark, path) == 5


def test_events_fit_the_event_table(spark):
    from medallion import schemas

    good = cdc.good_events(cdc.parse_entries(entries(spark)))
    moment = F.lit("2026-01-01 00:00:00").cast("timestamp")
    polled = cdc.row_events(spark.createDataFrame([("A", 1, "insert")], "no string, seq int, op string"), "op", ["no", "seq"], at=moment)
    for frame in (good, polled):
        table = frame.select(*schemas.EVENT.fieldNames())
        assert [f.dataType for f in table.schema] == [f.dataType for f in schemas.EVENT]
        assert all(r.bronze_rdb_event_id for r in table.collect())
    assert rows(good.select("bronze_rdb_event_id")) == rows(cdc.good_events(cdc.parse_entries(entries(spark))).select("bronze_rdb_event_id"))


def test_stream_folder_that_appears_later(spark):
    root = work_path(spark, "t")
    all_entries = entries(spark)
    all_entries.coalesce(1).write.json(f"{root}/in/stream=one")
    read = changes.file_entries(spark, f"{root}/in/*")
    args = (f"{root}/events", f"{root}/bad", f"{root}/c")
    changes.write_events(read, *args).awaitTermination()
    before = spark.read.parquet(f"{root}/events").count()
    all_entries.withColumn("msg_id", F.concat("msg_id", F.lit("-later"))).coalesce(1).write.json(f"{root}/in/stream=two")
    changes.write_events(changes.file_entries(spark, f"{root}/in/*"), *args).awaitTermination()
    assert before > 0 and spark.read.parquet(f"{root}/events").count() == 2 * before


def test_state_ends_in_event_time(spark):
    """With a watermark the result is the rule's, however late the stream runs."""
    data = sorted(_events(120), key=lambda e: e[1])
    root = work_path(spark, "t")
    for part in range(3):
        spark.createDataFrame(data[part * 40 : part * 40 + 40], "k string, ts timestamp, id int").coalesce(1).write.mode("append").parquet(f"{root}/in")
    stream = spark.readStream.schema("k string, ts timestamp, id int").option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    out = sightings.infer_operations_stream(stream, "k", "ts", "id", watermark="1 day")
    out.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/c").trigger(availableNow=True).start().awaitTermination(120)
    got = {r.id: r.change_operation for r in spark.read.parquet(f"{root}/out").collect()}
    assert got == _python_rule(data, timedelta(days=7))


def test_rounds_of_a_change_log_survive_a_crash(spark):
    """A round without its commit is read again whole; committed ids are never read twice, late ones are read."""
    path = work_path(spark, "rounds")
    log = spark.createDataFrame(
        [(i, "INSERT" if i % 2 else "Update", f"p{i % 3}", 1, i == 4) for i in range(10)],
        "id long, operation string, pilot_problem_no string, reform_numseq int, processed boolean")
    key = ["pilot_problem_no", "reform_numseq"]
    assert change_log.committed_events(spark, path) is None and change_log.processed_ids(spark, path) is None
    assert change_log.run_round(spark, log.where("id < 6 AND id <> 2"), path, key) == 0
    log.select(F.col("id").alias("log_id")).write.parquet(f"{path}/round=1")  # a round that died before its commit
    os.remove(f"{path}/round=1/_SUCCESS")
    assert {r.log_id for r in change_log.committed_events(spark, path).collect()} == {0, 1, 3, 5}
    assert change_log.run_round(spark, log, path, key) == 1
    second = change_log.committed_events(spark, path, only=1)
    assert sorted((r.log_id, r.change_operation, r.batch_id) for r in second.collect()) == [
        (2, "update", "p2:1"), (6, "update", "p0:1"), (7, "insert", "p1:1"), (8, "update", "p2:1"), (9, "insert", "p0:1")]
    assert change_log.run_round(spark, log, path, key) == 2 and change_log.committed_events(spark, path, only=2).count() == 0
    marked = cdc.mark_processed(log, change_log.processed_ids(spark, path))
    assert marked.where("NOT processed").count() == 0 and marked.count() == 10


def test_live_counts_of_all_stages(spark):
    """Counts follow new files of any stage, also after a restart."""
    root = work_path(spark, "stages")
    tables = {s: (f"{root}/{s}", spark.range(1).schema) for s in ("structuring", "masking", "chunking")}

    def add(stage, n):
        spark.range(n).coalesce(1).write.mode("append").parquet(f"{root}/{stage}")

    def counts():
        changes.write_stage_counts(changes.stage_rows(spark, tables), f"{root}/counts", f"{root}/state").awaitTermination()
        return {r.stage: r.docs_out for r in changes.latest_stage_counts(spark, f"{root}/counts", [*tables, "never"]).collect()}

    add("structuring", 5), add("masking", 2), add("chunking", 0)
    assert counts() == {"structuring": 5, "masking": 2, "chunking": 0, "never": 0}
    add("chunking", 30), add("masking", 1)
    assert counts() == {"structuring": 5, "masking": 3, "chunking": 30, "never": 0}
    assert counts()["chunking"] == 30


def test_stage_tables_are_written_in_parts(spark, tmp_path, monkeypatch):
    """A table of many files is written as many, and read a third of them per trigger; a small one as three files."""
    from medallion.plans import cdc_queries

    sizes = {"documents": 40, "labels": 1, "conversations": 7, "pages": 3}
    for name, parts in sizes.items():
        spark.range(0, 400, 1, parts).write.parquet(f"{tmp_path}/{name}.parquet")
    seen = {}
    original = changes.stage_rows
    monkeypatch.setattr(changes, "stage_rows", lambda s, stages, files: seen.update(
        {k: (len([f for f in os.listdir(p[5:] if p.startswith("file:") else p) if f.startswith("part-")]), files.get(k)) for k, (p, _) in stages.items()}) or original(s, stages, files))
    spark.conf.set("spark.sql.files.openCostInBytes", str(128 << 20))  # a partition per file
    try:
        got = {r.stage: r.docs_out for r in cdc_queries.stream_stage_counts(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == {"structuring": 400, "masking": 400, "chunking": 400, "enrichment": 400, "mapping": 0}
    assert seen["structuring"] == (40, 14) and seen["masking"] == (3, 1) and seen["chunking"][0] == 7


@pytest.mark.parametrize("kind", ["string", "bigint"])
def test_many_keys_share_a_state(spark, kind):
    """Three keys a group: the rule's result over three triggers, and no more states than groups; a missing key is a key."""
    number = {k: i + (1 << 60) for i, k in enumerate(sorted({e[0] for e in _events(400)}))}
    data = sorted(((None if k == "k4" else k if kind == "string" else number[k], t, i) for k, t, i in _events(400)), key=lambda e: e[1])
    schema, root = f"k {kind}, ts timestamp, id int", work_path(spark, "t")
    for part in range(3):
        spark.createDataFrame(data[part * 134 : part * 134 + 134], schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    out = sightings.infer_operations_stream(stream, "k", "ts", "id", groups=3)
    assert dict(out.dtypes)["k"] == kind
    query = out.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.read.parquet(f"{root}/out").collect()
    assert {r.id: r.change_operation for r in got} == _python_rule(data, timedelta(days=7))
    assert {r.id: r.k for r in got} == {i: k for k, _, i in data}
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 3
