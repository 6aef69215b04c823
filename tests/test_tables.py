"""Key-based operators, versions, hot keys and checks."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from medallion.operators import bronze, checks, history, silver, skew, tables
from tests.conftest import rows



def test_insert_ignore_keeps_existing_and_first(spark):
    target = spark.createDataFrame([(1, "old")], "k int, v string")
    batch = spark.createDataFrame([(1, "new"), (2, "b"), (2, "a"), (3, None)], "k int, v string")
    assert rows(tables.insert_ignore(target, batch, ["k"])) == [(2, "a"), (3, None)]
    again = target.unionByName(tables.insert_ignore(target, batch, ["k"]))
    assert tables.insert_ignore(again, batch, ["k"]).count() == 0


def test_last_wins(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 2, "c"), (2, 1, None)], "k int, o int, v string")
    assert rows(tables.last_per_key(df, ["k"], ["o"])) == [(1, 2, "c"), (2, 1, None)]


def test_mutations(spark):
    target = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (3, "c", 1)], "k int, v string, w int")
    changes = spark.createDataFrame(
        [(1, "A", 9, "update"), (2, None, None, "delete"), (3, "C", 9, "insert"), (4, "d", 9, "insert"), (5, "e", 9, "update"), (6, "f", 9, "delete")],
        "k int, v string, w int, op string",
    )
    assert rows(tables.apply_mutations(target, changes, ["k"], set_columns=["v"])) == [(1, "A", 1), (3, "c", 1), (4, "d", 9)]
    assert rows(tables.mutation_report(target, changes, ["k"])) == [("delete", 1, 1), ("insert", 1, 1), ("update", 1, 1)]


def test_snapshot_diff(spark):
    before = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string")
    after = spark.createDataFrame([(1, "a"), (3, "c"), (4, "d")], "k int, v string")
    assert rows(tables.snapshot_diff(before, after, ["k"], ["v"])) == [(2, "DELETE"), (3, "UPDATE"), (4, "INSERT")]


def test_current_state_and_upsert(spark):
    changes = spark.createDataFrame([(1, 1, "insert"), (1, 2, "delete"), (2, 1, "insert"), (2, 3, "update")], "k int, t int, change_operation string")
    assert rows(tables.current_state(changes, ["k"], ["t"])) == [(2, 3, "update")]
    target = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    incoming = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "k int, v string, o int")
    assert rows(tables.upsert(target, incoming, ["k"], ["o"])) == [(1, "a"), (2, "y"), (3, "z")]


def test_defaults_only_for_missing(spark):
    df = spark.createDataFrame([(1, True, None), (2, None, None)], "k int, found boolean, v string")
    df = tables.with_defaults(df, {"w": "W", "v": "unused"})
    got = rows(df.select("k", tables.default_when_missing("found", F.col("v"), "D"), "w"))
    assert got == [(1, None, "W"), (2, "D", "W")]


def test_lookup_or_first(spark):
    df = spark.createDataFrame([(3,), (1,), (2,)], "k int")
    assert tables.lookup_or_first(df, "k", 2, ["k"]).first().k == 2
    assert tables.lookup_or_first(df, "k", 9, ["k"]).first().k == 1


def _skewed(spark, n=900):
    rng = random.Random(1)
    data = [("hot" if i % 3 else f"k{i % 7}", rng.randint(0, 200), i, f"h{rng.randint(0, 2)}") for i in range(n)]
    return spark.createDataFrame(data, "key string, valid_from long, seq long, content_hash string")


def _plain_neighbour(df, value, step):
    shift = F.lead if step > 0 else F.lag
    return df.withColumn("n", shift(value).over(W.partitionBy("key").orderBy("valid_from", "seq")))


@pytest.mark.parametrize("step", [1, -1])
@pytest.mark.parametrize("partitions", [1, 7, 40])
def test_neighbour_equals_plain_window(spark, step, partitions):
    df = _skewed(spark)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        for own in (df, df.withColumn("valid_from", F.lit(5)), df.withColumn("key", F.lit(None).cast("string")), df.limit(0)):
            got = skew.neighbour(own, ["key"], ["valid_from", "seq"], "content_hash", "n", step)
            assert got.columns == [*own.columns, "n"]
            assert rows(got) == rows(_plain_neighbour(own, "content_hash", step))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_key_of_one_time_is_split(spark):
    """One load time for a whole batch of one key: no window holds them all."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "20")
    try:
        df = spark.range(5000).selectExpr("'k' AS key", "10L AS valid_from", "id AS seq", "'h' AS content_hash")
        got = history.versions(df, "key", "valid_from", "seq")
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert all("_range" in w[:60] for w in plan.split("windowspecdefinition(")[1:] if "lead(_v" in w[-200:]) and "_range" in plan
        found = skew.ranges(df, ["key"], ["valid_from", "seq"])
        sizes = [r["count"] for r in df.groupBy(found.number(df).alias("r")).count().collect()]
        assert len(sizes) == 20 and max(sizes) < 1000
        assert got.where("is_latest").count() == 1 and got.where("valid_to = 10").count() == 4999
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_versions_shuffle_the_rows_once(spark):
    """One exchange of all columns; what else is shuffled is one row per range, and nothing is written."""
    df = _skewed(spark).withColumn("payload", F.repeat("content_hash", 50))
    got = history.versions(df, "key", "valid_from", "seq")
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("== Initial Plan ==")[0]
    shuffled = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    below = plan.split("Exchange hashpartitioning")
    assert sum("payload" in b.split("Scan ExistingRDD")[0] for b in below[1:]) <= 1, plan
    assert 1 <= len(shuffled) <= 3 and "FileScan" not in plan


def test_ranges_of_times_and_dates(spark):
    df = _skewed(spark).withColumn("valid_from", F.timestamp_micros(F.col("valid_from") * 3_600_000_001)).withColumn("seq", F.date_add(F.lit("2024-02-27").cast("date"), F.col("seq").cast("int")))
    got = skew.neighbour(df, ["key"], ["valid_from", "seq"], "content_hash", "n")
    assert rows(got) == rows(_plain_neighbour(df, "content_hash", 1))


def test_null_keys_are_not_registered(spark):
    hub = spark.createDataFrame([("a", 1)], "k string, v int")
    batch = spark.createDataFrame([("a", 2), ("b", 3), (None, 4), (None, 5)], "k string, v int")
    assert rows(tables.insert_ignore(hub, batch, ["k"])) == [("b", 3)]
    assert rows(tables.null_keys(batch, ["k"])) == [(None, 4), (None, 5)]


def test_snapshot_diff_sees_microseconds_and_nulls(spark):
    before = spark.sql("SELECT 1 AS k, timestamp_micros(1000001) AS t UNION ALL SELECT 2, NULL UNION ALL SELECT 3, NULL")
    after = spark.sql("SELECT 1 AS k, timestamp_micros(1000002) AS t UNION ALL SELECT 2, NULL UNION ALL SELECT 3, timestamp_micros(0)")
    assert rows(tables.snapshot_diff(before, after, ["k"], ["t"])) == [(1, "UPDATE"), (3, "UPDATE")]


def _doc(key, h, ts, seq):
    return Row(key=key, content_hash=h, valid_from=ts, seq=seq)


def test_scd2_apply(spark):
    first = spark.createDataFrame([_doc("a", "1", 10, 1), _doc("b", "1", 10, 2)])
    current = history.versions(first, "key", "valid_from", "seq")
    batch = spark.createDataFrame([_doc("a", "1", 20, 3), _doc("a", "2", 20, 4), _doc("c", "1", 20, 5)])
    out = history.scd2_apply(current, batch, "key")
    got = sorted((r.key, r.content_hash, r.valid_from, r.valid_to or 0, r.is_latest) for r in out.collect())
    assert got == [
        ("a", "1", 10, 20, False), ("a", "1", 20, 20, False), ("a", "2", 20, 0, True), ("b", "1", 10, 0, True), ("c", "1", 20, 0, True),
    ]
    changed = history.scd2_apply(current, batch, "key", changed_only=True)
    got = sorted((r.key, r.content_hash, r.valid_from, r.valid_to or 0, r.is_latest) for r in changed.collect())
    assert got == [("a", "1", 10, 20, False), ("a", "2", 20, 0, True), ("b", "1", 10, 0, True), ("c", "1", 20, 0, True)]


def test_json_arrays(spark):
    df = spark.createDataFrame([('[{"part_no":"1"}]',), ("{bad",), (None,), ("[]",)], "j string")
    got = [None if r.p is None else [x.part_no for x in r.p] for r in df.select(silver.json_array("j", silver.PARTS).alias("p")).collect()]
    assert got == [["1"], [], None, []]


def test_document_fields(spark):
    df = spark.createDataFrame(
        [
            (1, '{"data":{"prob":{"pclrty_class":"PUBLIC","pilot_problem_importnrate_typecd":null},"vehiclefuse":{"pilot_vhclmodel_no":"NX02"}}}'),
            (2, "{}"), (3, "{bad"), (4, None),
        ],
        "id int, c string",
    )
    got = rows(df.select("id", silver.document_fields("c").alias("f")).select("id", "f.*"))
    assert got == [(1, "PUBLIC", None, "NX02"), (2, "INTERNAL", "A", "NX01"), (3, "INTERNAL", "", ""), (4, "INTERNAL", "", "")]


def test_parity(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    b = spark.createDataFrame([(1,), (3,)], "k int")
    assert rows(bronze.parity(a, b, ["k"])) == [(3, 2, 2, 1, True)]


def test_registry_one_row_per_event(spark):
    recs = spark.createDataFrame([("a", "b1"), ("a", "b2"), ("c", "b2")], "source_primary_key string, batch_id string")
    recs = recs.withColumn("s3_path", F.concat(F.lit("p/"), "batch_id"))
    events = bronze.load_events(recs, "batch_id", "s3_path", "2026-01-01 00:00:00")
    hub = bronze.hub_rows(recs, F.col("source_primary_key"), "2026-01-01 00:00:00").distinct()
    sat = bronze.satellites(hub, "2026-01-01 00:00:00")
    linked = recs.join(events.select("batch_id", "bronze_rdb_event_id"), "batch_id")
    linked = linked.join(hub.select(bronze.HUB_KEY, "source_primary_key"), "source_primary_key")
    link = bronze.links(linked, "bronze_rdb_event_id")
    assert bronze.registry(hub, link, events, sat).count() == 3
    assert bronze.registry(hub, link, events, sat, latest_event_only=True).count() == 2


def test_checks(spark):
    df = spark.createDataFrame([(1, None), (1, "a"), (2, "b")], "k int, v string")
    parent = spark.createDataFrame([(2,)], "k int")
    assert rows(checks.duplicate_keys(df, ["k"])) == [(1, 2)]
    assert rows(checks.orphans(df, "k", parent)) == [(1, 2)]
    assert rows(checks.null_violations(df, ["k", "v", "absent"])) == [("absent", 3), ("k", 0), ("v", 1)]
    got = rows(checks.reconcile({"a": df, "b": parent}, [("r1", "a", "b", 3), ("r2", "b", "a", 1)]))
    assert got == [("r1", 3, 3, True), ("r2", 1, 3, False)]
