"""The whole way over stage tables: golden numbers, reruns, spans, hooks, sample reports."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from medallion import schemas as S
from medallion.functions.masking import mask_documents
from medallion.operators import bronze, checks, silver, spans, stages, stats
from medallion.session import work_path
from tests.conftest import rows
from tests.reports import sample_reports

TABLES = {"masked": S.MASKED, "chunked": S.CHUNK, "enriched": S.ENRICHED, "staged": S.STAGED}


def structured(spark, n=5):
    reports = sample_reports(spark, n).withColumn("s3_path", F.lit("s3://bronze/1")).withColumn("_seq", F.lit(1))
    reports = reports.withColumn("source_primary_key", F.concat_ws("||", "pilot_problem_no", "reform_numseq"))
    hub = bronze.hub_rows(reports, F.col("source_primary_key"), "2026-01-01 00:00:00")
    registry = hub.select(bronze.HUB_KEY, "source_primary_key").withColumn("s3_path", F.lit("s3://bronze/1"))
    docs = silver.structure(silver.probe_batches(registry, reports, "_seq"))
    return hub, docs.select(
        F.sha2(bronze.HUB_KEY, 256).alias("structured_doc_id"), bronze.HUB_KEY, "structured_content", F.lit(True).alias("is_latest")
    )


def run_stages(spark, root, docs):
    def t(name):
        return stages.read_stage(spark, f"{root}/{name}", TABLES[name])

    def run(name, pending, transform):
        stages.run_stage(spark, f"{root}/{name}", TABLES[name], pending, transform)

    run("masked", lambda done: stages.to_mask(docs, done), stages.mask_stage)
    run("chunked", lambda done: stages.to_chunk(t("masked"), done), lambda rows_: stages.chunk_stage(rows_, keep_all=False))
    run("enriched", lambda done: stages.to_enrich(t("chunked"), t("masked"), docs, done), stages.enrich_stage)
    run("staged", lambda done: stages.to_stage(t("enriched"), t("chunked"), t("masked"), docs, done), stages.stage_stage)
    return {name: t(name) for name in TABLES}


@pytest.fixture(scope="module")
def chain(spark):
    root = work_path(spark, "chain")
    hub, docs = structured(spark)
    return root, hub, docs, run_stages(spark, root, docs)


def test_golden_numbers(chain):
    _, hub, docs, out = chain
    assert (hub.count(), docs.count()) == (5, 5)
    assert [out[n].count() for n in TABLES] == [5, 15, 15, 15]
    masked = out["masked"].collect()
    assert sorted(r.pii_detection_count for r in masked) == [2, 2, 8, 8, 8]
    assert all(set(r.pii_pattern_types.values()) == {2} for r in masked)
    assert sum(r.is_masked for r in masked) == 3
    by_class = {r.pclrty_class: r.n for r in out["staged"].groupBy("pclrty_class").agg(F.count("*").alias("n")).collect()}
    assert by_class == {"RESTRICTED": 3, "INTERNAL": 9, "PUBLIC": 3}


def test_rerun_adds_nothing(spark, chain):
    root, _, docs, out = chain
    before = {n: out[n].count() for n in TABLES}
    again = run_stages(spark, root, docs)
    assert {n: again[n].count() for n in TABLES} == before


def test_constraints_hold(chain):
    _, hub, docs, out = chain
    tables = {"hub": hub, "structured": docs, **out}
    for name, key in S.PRIMARY_KEYS.items():
        if name in tables:
            assert checks.duplicate_keys(tables[name], [key]).count() == 0
    for child, key, parent in S.FOREIGN_KEYS:
        if child in tables and parent in tables:
            assert checks.orphans(tables[child], key, tables[parent]).count() == 0
    for name, columns in S.REQUIRED.items():
        if name in tables:
            assert all(r.nulls == 0 for r in checks.null_violations(tables[name], columns).collect())


def test_index_and_mark(chain):
    *_, out = chain
    source = stages.to_index(out["staged"], out["enriched"], out["chunked"])
    assert source.count() == 15
    done = stages.mark_indexed(out["staged"], source.select("staged_id"))
    assert stages.to_index(done, out["enriched"], out["chunked"]).count() == 0


def test_rollup_and_view(chain):
    _, hub, docs, out = chain
    view = stats.document_view(stats.document_rollup(out["staged"], out["enriched"], out["chunked"], out["masked"], docs, hub))
    assert view.count() == 5
    shown = stats.filter_documents(view, masked_only=True).collect()
    assert len(shown) == 3 and all(len(r.piiCounts) == 4 for r in shown)
    assert rows(stats.masking_stats(out["masked"])) == [(3, 2, 5)]


def test_mask_stage_masks_leaf_texts(spark):
    docs = spark.createDataFrame([("1", '{"t":"a\\n010-1234-5678 \\\\n x"}')], "structured_doc_id string, structured_content string")
    assert stages.mask_stage(docs, on="json").first().pii_detection_count == 0
    row = stages.mask_stage(docs).first()
    assert row.pii_detection_count == 1 and row.masked_content == '{"t":"a\\n010****1234 \\\\n x"}'
    for letter in "nrtbf":
        one = spark.createDataFrame([("1", '{"t":"\\%s\\%s010-1234-5678"}' % (letter, letter))], "structured_doc_id string, structured_content string")
        assert stages.mask_stage(one).first().masked_content == '{"t":"\\%s\\%s010****1234"}' % (letter, letter)


def test_two_layer_mask_stage(spark):
    docs = spark.createDataFrame([("1", '{"t":"Kim\\n010-1234-5678"}'), ("2", '{"t":"none"}')], "structured_doc_id string, structured_content string")

    def detector():
        return lambda texts: [[("PERSON", t.index("Kim"), t.index("Kim") + 3, 0.9)] if "Kim" in t else [] for t in texts]

    got = {r.structured_doc_id: r for r in stages.mask_stage(docs, detector=detector).collect()}
    assert got["1"].masked_content == '{"t":"[KR_NAME]\\n010****1234"}' and got["1"].masking_method == "presidio_2layer"
    assert got["1"].pii_pattern_types == {"KR_PHONE": 1, "KR_NAME": 1, "KR_ADDRESS": 0}
    assert got["2"].pii_pattern_types == {"KR_NAME": 0, "KR_ADDRESS": 0}


def test_hook_contract(spark, chain):
    *_, out = chain
    with pytest.raises(ValueError):
        stages.chunk_stage(out["masked"], lambda df: df.select("masked_doc_id"))
    own = stages.chunk_stage(
        out["masked"], lambda df: df.select("masked_doc_id", F.lit(0).alias("chunk_sequence"), F.col("masked_content").alias("chunk_content"))
    )
    assert own.count() == 5


def test_spans(spark):
    docs = mask_documents(spark.createDataFrame([(1, "😀홍길동 in 서울 010-1234-5678"), (2, "none")], "doc int, t string"), "t")
    data = [(1, "PERSON", 1, 4, 0.6), (1, "LOCATION", 8, 10, 0.9), (1, "GPE", 8, 9, 0.9), (1, "PERSON", 5, 7, 0.59), (1, "DATE", 5, 7, 1.0)]
    found = spark.createDataFrame(data, "doc int, entity_type string, start int, `end` int, score double")
    got = {r.doc: r for r in spans.mask_spans(docs, found, "doc").collect()}
    assert got[1].masked_content == "😀[KR_NAME] in [KR_ADDRESS] 010****1234"
    assert got[1].pii_pattern_types == {"KR_PHONE": 1, "KR_NAME": 1, "KR_ADDRESS": 2}
    assert got[1].is_masked and got[1].masking_method == "presidio_2layer"
    assert got[2].pii_pattern_types == {"KR_NAME": 0, "KR_ADDRESS": 0} and got[2].masked_content == "none"
    without = {r.doc: r for r in spans.mask_spans(docs, None, "doc").collect()}
    assert without[1].pii_pattern_types == {"KR_PHONE": 1, "KR_NAME": 0, "KR_ADDRESS": 0}


def test_detector_hook(spark):
    docs = spark.createDataFrame([(1, "ab Kim cd"), (2, "x")], "doc int, t string")

    def detector():
        return lambda texts: [[("PERSON", t.index("Kim"), t.index("Kim") + 3, 0.9)] if "Kim" in t else [] for t in texts]

    assert rows(spans.detect_spans(docs, "doc", "t", detector)) == [(1, "PERSON", 3, 6, 0.9)]


def test_indexed_ids_are_recorded_once(spark):
    path = work_path(spark, "indexed")
    staged = spark.createDataFrame([("a", "staged"), ("b", "staged"), ("c", "staged")], "staged_id string, indexing_status string")
    stages.write_indexed(spark, spark.createDataFrame([("a",), ("a",)], "staged_id string"), path)
    done = stages.write_indexed(spark, spark.createDataFrame([("a",), ("c",)], "staged_id string"), path)
    assert rows(done) == [("a",), ("c",)]
    assert rows(stages.mark_indexed(staged, done).select("staged_id", "indexing_status")) == [("a", "indexed"), ("b", "staged"), ("c", "indexed")]


def test_masking_after_any_control_character(spark):
    phone = "010-1234-5678"
    texts = [f"{chr(c)}{phone}{chr(c)}end" for c in range(32)] + [f"\\u000B{phone}", f"\\\\{chr(11)}{phone}", f"x{chr(31)}\\n{phone}"]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "structured_doc_id string, t string")
    df = df.select("structured_doc_id", F.to_json(F.struct("t")).alias("structured_content"))
    out = stages.mask_stage(df).select("structured_doc_id", "masked_content", "pii_detection_count", F.from_json("masked_content", "t string")["t"].alias("t"))
    got = {int(r.structured_doc_id): r for r in out.collect()}
    for i in range(32):
        assert got[i].t == f"{chr(i)}010****1234{chr(i)}end", i
        assert not any(ord(c) < 32 for c in got[i].masked_content)  # still JSON
    assert got[32].t == texts[32]  # a real backslash, u, digits and a letter: no word begins there
    assert got[33].t == f"\\\\{chr(11)}010****1234" and got[34].t.startswith(f"x{chr(31)}")


def test_a_text_the_detector_fails_on_costs_no_other_its_spans(spark):
    def detector():
        def model(texts):
            if any(t == "bad" for t in texts):
                raise RuntimeError("model")
            return [[("PERSON", 0, 2, 0.9)] if t and t.startswith("Al") else [] for t in texts]
        return model

    def broken():
        raise OSError("no model")

    docs = spark.createDataFrame([(1, "Al x"), (2, "bad"), (3, None), (4, "Al y")], "doc long, t string").coalesce(1)
    found = spans.detect_spans(docs, "doc", "t", detector)
    assert rows(found) == [(1, "PERSON", 0, 2, 0.9), (2, None, None, None, None), (4, "PERSON", 0, 2, 0.9)]
    assert [r[0] for r in rows(spans.detect_spans(docs, "doc", "t", broken).where("entity_type IS NULL"))] == [1, 2, 3, 4]
    masked = spans.mask_spans(docs.withColumn("pii_pattern_types", F.create_map().cast("map<string,int>")), found, "doc", "t")
    assert {r["doc"]: r["t"] for r in masked.collect()}[2] == "bad"


def _plain_unescaped(text):
    """The escapes by the rule of JSON, one after the other from the left."""
    out, i = [], 0
    known = {v: k for k, v in {"\n": "n", "\t": "t", "\r": "r", "\b": "b", "\f": "f"}.items()}
    while i < len(text):
        if text[i] != "\\" or i + 1 == len(text):
            out.append(text[i])
            i += 1
        elif text[i + 1] in known:
            out.append(known[text[i + 1]])
            i += 2
        elif text[i + 1] in "uU" and re.match(r"00[01][0-9A-Fa-f]", text[i + 2:]) and chr(int(text[i + 2:i + 6], 16)) not in known.values():
            out.append(chr(int(text[i + 2:i + 6], 16)))
            i += 6
        else:
            out.append(text[i:i + 2])
            i += 2
    return "".join(out)


def test_escapes_in_few_passes(spark):
    """Any runs of backslashes and escapes, read by the rule; the plan has no pattern per control character."""
    rng = random.Random(5)
    bits = ["\\", "\\\\", "n", "u000b", "u000A", "U001F", "u0020", "u00", "x", "", "\\u0001", "\\n", '\\"', "\\u001g", "\\u001", "é😀"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 12))) for _ in range(400)] + ["", "\\", "\\u000B"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", "t", stages._unescaped(F.col("t")).alias("u"))
    df = df.withColumn("back", stages._escaped(F.col("u")))
    names = {chr(c): "\\" + {"\n": "n", "\t": "t", "\r": "r", "\b": "b", "\f": "f"}.get(chr(c), f"u{c:04X}") for c in range(32)}
    for r in df.collect():
        assert r.u == _plain_unescaped(r.t), r.t
        assert r.back == "".join(names.get(c, c) for c in r.u), r.t
    plan = stages.mask_stage(df.select(F.col("i").alias("structured_doc_id"), F.col("t").alias("structured_content")))
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "(?i:" not in text and text.count("regexp_replace") <= 4
