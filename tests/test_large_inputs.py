"""Dictionaries in blocks, comparisons by fingerprints and substring postings, against plain Python."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from medallion.operators import bronze, dictionary, fingerprints, substring_index, tables

from .conftest import rows

TEXTS = ["abcabc", "", None, "xaby", "ab" * 50_000, "가나다 ab", "😀é cab", "ab", "ab"]
CODES = ["ab", "abc", "bca", "다", "😀é", "", None, "ab", "zzz", "c"]


@pytest.mark.parametrize("block", [1_000_000, 4, 1])
def test_dictionary_blocks_agree_with_a_scan(spark, block):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "`a.b` int, text string").withColumn("row_0", F.lit("x"))
    codes = spark.createDataFrame([(c,) for c in CODES], "code string")
    got = dictionary.dictionary_entities(df, "text", codes, block_chars=block).collect()
    real = {c for c in CODES if c}
    assert sorted((r["a.b"], r["row_0"], r["entities"]) for r in got) == [
        (i, "x", sorted(c for c in real if t and c in t)) for i, t in enumerate(TEXTS)]


def test_dictionary_empty_tables(spark):
    df = spark.createDataFrame([(1, "ab")], "k int, text string")
    none = spark.createDataFrame([], "code string")
    assert rows(dictionary.dictionary_entities(df, "text", none)) == [(1, "ab", [])]
    codes = spark.createDataFrame([("ab",)], "code string")
    assert dictionary.dictionary_entities(df.limit(0), "text", codes).count() == 0
    with pytest.raises(ValueError):
        dictionary.dictionary_entities(df, "text", codes, into="K")


def test_dictionary_is_matched_once_and_not_in_the_plan(spark):
    df = spark.createDataFrame([(1, "ab cd")], "k int, text string")
    codes = spark.range(5000).select(F.concat(F.lit("code"), F.col("id").cast("string")).alias("code"))
    found = dictionary.dictionary_entities(df, "text", codes)
    plan = found.where(F.size("entities") > 0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "code4999" not in plan and "Exchange" not in plan


def _plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("buckets", [1, 7, 4096])
def test_snapshot_diff_by_any_number_of_buckets(spark, buckets):
    rng = random.Random(buckets)
    before = {k: (rng.choice([None, 0, 1]), rng.choice([None, 1.5, float("nan")])) for k in range(300)}
    after = {k: v for k, v in before.items() if k % 50}
    after.update({7: (5, None), 8: (before[8][0], -2.0), 1000: (None, None)})
    made = [spark.createDataFrame([(k, *v) for k, v in side.items()], "k int, v int, w double") for side in (before, after)]
    want = [(k, "DELETE") for k in before if k not in after] + [(7, "UPDATE"), (8, "UPDATE"), (1000, "INSERT")]
    assert rows(tables.snapshot_diff(*made, ["k"], ["v", "w"], buckets)) == sorted(want, key=lambda r: str(r[0]))
    assert rows(tables.snapshot_diff(made[0], made[0], ["k"], ["v", "w"], buckets)) == []


def test_nulls_move_between_columns_and_elements(spark):
    schema = "k int, a string, b string, c array<int>, s struct<x:int,y:int>, m map<string,int>"
    before = spark.createDataFrame([(1, None, "x", [None, 1], (None, 1), {"p": 1, "q": None}), (2, "x", None, None, None, None)], schema)
    after = spark.createDataFrame([(1, "x", None, [None, 1], (None, 1), {"q": None, "p": 1}), (2, "x", None, None, None, None)], schema)
    for columns, changed in ((["a", "b"], 1), (["c", "s", "m"], 0)):
        assert fingerprints.Comparison(before, after, ["k", *columns], ["k"]).buckets.where("differs").count() == changed
    other = spark.createDataFrame([(1, "x", None, [1, None], (1, None), {"q": 1, "p": None})], schema)
    for column in ("c", "s", "m"):
        assert fingerprints.Comparison(after.where("k = 1"), other, ["k", column], ["k"]).buckets.where("differs").count() == 1


def test_null_keys_and_types_that_differ(spark):
    before = spark.createDataFrame([(None, 1), (2, 1)], "k int, v int")
    after = spark.createDataFrame([(None, 1), (2, 2)], "k long, v long")
    assert rows(tables.snapshot_diff(before, after, ["k"], ["v"])) == [(2, "UPDATE")]


@pytest.mark.parametrize("buckets", [1, 3, 4096])
def test_parity_counts_as_multisets(spark, buckets):
    rng = random.Random(1)
    sides = [[(rng.randrange(40), rng.choice(["a", None])) for _ in range(n)] for n in (200, 150)]
    a, b = (Counter(s) for s in sides)
    frames = [spark.createDataFrame(s, "k int, v string") for s in sides]
    assert rows(bronze.parity(*frames, ["k", "v"], buckets)) == [(200, 150, (a - b).total(), (b - a).total(), True)]
    assert rows(bronze.parity(frames[0], frames[0], ["k", "v"], buckets)) == [(200, 200, 0, 0, True)]
    none = frames[0].limit(0)
    assert rows(bronze.parity(none, none, ["k", "v"], buckets)) == [(0, 0, 0, 0, True)]


def test_equal_tables_send_sums_only(spark, tmp_path):
    spark.range(20_000).selectExpr("id AS k", "id * 2 AS v").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    assert fingerprints.Comparison(df, df, ["k", "v"], ["k"]).suspects().count() == 0
    changed = df.withColumn("v", F.when(F.col("k") == 9, -1).otherwise(F.col("v")))
    assert 0 < fingerprints.Comparison(df, changed, ["k", "v"], ["k"]).suspects().count() < 100
    plan = _plan(tables.snapshot_diff(df, changed, ["k"], ["v"]))
    # The rows meet the broadcast buckets before they are shuffled.
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_substrings_by_postings(spark, tmp_path):
    rng = random.Random(3)
    made = [(i % 90, "".join(rng.choices("ab é😀", k=rng.randrange(0, 40))) or None, "".join(rng.choices("abc\n", k=5))) for i in range(100)]
    view = spark.createDataFrame(made, "doc_id int, title string, summary string")
    substring_index.write_substring_index(view, str(tmp_path / "i"), "doc_id")
    index = substring_index.read_substring_index(spark, str(tmp_path / "i"), "doc_id")
    for asked in ("ab", "a", "aba", "abab", "é😀a", "b\nc", " a ", "   ", "", "qqq", "ababab ab", "'a"):
        want = [r for r in made if asked.strip() and (asked in (r[1] or "") or asked in r[2])]
        assert rows(substring_index.indexed_substring_search(index, asked)) == sorted(want, key=lambda r: tuple(str(v) for v in r)), asked


def test_substrings_by_join(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(substring_index, "NAMED_IDS", 0)
    test_substrings_by_postings(spark, tmp_path)
