from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from medallion.llm import decontaminate, near_dup, packing, pii, quality, queries
from medallion.llm.common import table
from medallion.session import materialized
from tools.check_queries import TABLES, rows_of


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_like_its_sql(llm, sf, name):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    frame = entry.queries()[name](llm, sf)
    cursor = con.execute(queries.ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(frame.columns) == sorted(names)
    assert rows_of(frame.collect(), frame.columns) == rows_of(cursor.fetchall(), names)


def test_one_query_for_each_operator():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "benchmark_passages", "personal_data", "best_fit_packing"]


def test_stages(llm, sf):
    """Every stage's decisions, each judged on the rows its predecessor kept."""
    docs = table(llm, sf, "documents")
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(materialized(stage(llm, kept[-1], sf), f"test-{name}"))
    assert all(k.columns == docs.columns for k in kept[:-1])
    rows = [{r["doc_id"]: r for r in k.collect()} for k in kept[:-1]]

    good = {i for i, r in rows[0].items() if not any(rule.rejects(quality.Text(r["text"].encode())) for rule in quality.RULES)}
    assert set(rows[1]) == good
    bags = {i: near_dup.shingles(r["text"].encode()) for i, r in rows[1].items()}
    for i in rows[1]:
        near = [j for j in rows[2] if near_dup.similarity(bags[i], bags[j]) >= 0.8]
        assert near == [i] if i in rows[2] else near
    windows = decontaminate.Windows([(str(r["item_id"]), r["text"].encode()) for r in table(llm, sf, "benchmark").collect()])
    assert set(rows[3]) == {i for i, r in rows[2].items() if next(windows.scan([r["text"].encode()]))[1] == 0}
    assert set(rows[4]) == set(rows[3])
    for i, r in rows[4].items():
        assert pii.base_spans(r["text"]) == [] and r["n_chars"] == len(r["text"])
        assert r["text"] == rows[3][i]["text"] or pii.base_spans(rows[3][i]["text"])
    assert {r["doc_id"] for r in kept[-1].collect()} == set(rows[4])
    assert all(0 < r["length"] <= packing.CAPACITY for r in kept[-1].collect())


def test_run_takes_an_empty_table(llm, sf):
    docs = table(llm, sf, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = materialized(stage(llm, docs, sf), f"empty-{name}")
        assert docs.count() == 0


def test_stages_bear_odd_rows(llm, sf, odd):
    docs = odd.selectExpr("doc_id", "text", "source AS lang", "source", "cast(`row` AS long) AS n_chars", "c0 AS redacted", "n")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(llm, docs, sf)
        assert out.count() <= docs.count() or name == "best_fit_packing"
        assert out.columns == docs.columns or name == "best_fit_packing"
