"""Queries over structuring, versions, incremental stages and masking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.keys import row_hash
from ..functions.mapping import security_class
from ..functions.masking import mask_documents
from ..functions.text import computed_once
from ..operators import history as H
from ..operators import silver as S
from ..operators import spans as SP
from ..operators import stages as ST
from ..operators import stats
from ..session import materialized, spread_small, work_path
from .inputs import REPORTS_SQL, reports, sql_class, sql_masked
from .registry import query, table

_REPORT_CODE = "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'S' WHEN '2' THEN 'A' WHEN '3' THEN 'B' WHEN '4' THEN 'C' ELSE NULL END"


def _order_registry(spark, d):
    """Orders as batch rows with JSON parts, and a registry that also names keys no batch row has."""
    orders = table(spark, d, "orders")
    digit = F.substring("o_orderpriority", 1, 1)
    code = (
        F.when(digit == "1", "S").when(digit == "2", "A").when(digit == "3", "B").when(digit == "4", "C")
    )
    one = F.concat(
        F.lit('[{"part_no":"P'), F.col("o_orderkey").cast("string"), F.lit('","part_name":"'), F.col("o_orderstatus"),
        F.lit('","manfproc_typecd":"WELD"}]'),
    )
    parts = F.when(F.col("o_orderstatus") == "F", one).when(F.col("o_orderstatus") == "O", F.lit("{broken"))
    batch = orders.select(
        F.concat(F.col("o_orderkey").cast("string"), F.lit("||1")).alias("source_primary_key"),
        F.col("o_orderkey").cast("string").alias("pilot_problem_no"),
        F.lit(1).alias("reform_numseq"),
        code.alias("pilot_problem_importnrate_typecd"),
        F.concat(F.lit("NX0"), (F.col("o_custkey") % 3 + 1).cast("string")).alias("pilot_vhclmodel_no"),
        F.col("o_orderstatus").alias("problem_content"),
        F.lit("done").alias("cntmeasure_content"),
        F.col("o_orderpriority").alias("display_content"),
        F.col("o_orderpriority").alias("dept_name"),
        F.col("o_custkey").cast("string").alias("reg_empno"),
        parts.alias("parts"),
        F.lit('[{"pilot_step_typecd":"D"},{"pilot_step_typecd":"P"}]').alias("steps"),
        F.lit("s3://bronze/orders").alias("s3_path"),
        F.col("o_orderkey").alias("_seq"),
    )
    missing = table(spark, d, "customer").select(
        F.concat(F.lit("C"), F.col("c_custkey").cast("string"), F.lit("||7")).alias("source_primary_key")
    )
    registry = batch.select("source_primary_key").unionByName(missing).withColumn("s3_path", F.lit("s3://bronze/orders"))
    return registry, batch


@query(
    "structure_document",
    f"""WITH o AS (SELECT *, {_REPORT_CODE} AS code FROM orders)
SELECT o_orderkey || '||1' AS source_primary_key, CAST(o_orderkey AS VARCHAR) AS problem_no, 1 AS seq, code AS importance,
  {sql_class('code')} AS pclrty_class, 'NX0' || CAST(o_custkey % 3 + 1 AS VARCHAR) AS model, o_orderstatus AS problem,
  o_orderpriority AS dept, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 ELSE NULL END AS parts, 2 AS steps,
  CASE o_orderstatus WHEN 'F' THEN 'P' || CAST(o_orderkey AS VARCHAR) ELSE NULL END AS first_part FROM o
UNION ALL
SELECT 'C' || c_custkey || '||7', 'C' || c_custkey, 1, 'A', 'INTERNAL', 'NX01', '', '', 0, 0, NULL FROM customer""",
)
def structure_document(spark, d):
    """PRJ-2, PRJ-3, JSN-1, JSN-2, JOIN-2: bad JSON, NULL JSON and keys without a row included."""
    registry, batch = _order_registry(spark, d)
    doc = S.structure(S.probe_batches(spread_small(registry), batch, "_seq"))
    prob = "structured.data.prob"
    part = F.col("structured.data.part")
    return doc.select(
        "source_primary_key",
        F.col(f"{prob}.pilot_problem_no").alias("problem_no"),
        F.col(f"{prob}.reform_numseq").alias("seq"),
        F.col(f"{prob}.pilot_problem_importnrate_typecd").alias("importance"),
        F.col(f"{prob}.pclrty_class").alias("pclrty_class"),
        F.col("structured.data.vehiclefuse.pilot_vhclmodel_no").alias("model"),
        F.col(f"{prob}.problem_content").alias("problem"),
        F.col("structured.display.dept_name").alias("dept"),
        F.when(part.isNotNull(), F.size(part)).alias("parts"),
        F.size("structured.data.step").alias("steps"),
        F.get(part, F.lit(0))["part_no"].alias("first_part"),
    )


@query(
    "content_hash",
    """SELECT o_orderkey, md5('{"key":' || o_orderkey || ',"status":' ||
  CASE WHEN o_orderstatus = 'P' THEN 'null' ELSE '"' || o_orderstatus || '"' END ||
  ',"lines":[{"priority":"' || o_orderpriority || '"}]}') AS content_hash, md5(o_orderkey || '||' || o_custkey) AS row_hash
FROM orders""",
)
def content_hash(spark, d):
    """KEY-5, KEY-7: the hash of the serialised document keeps NULL fields."""
    document = F.struct(
        F.col("o_orderkey").alias("key"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status"),
        F.array(F.struct(F.col("o_orderpriority").alias("priority"))).alias("lines"),
    )
    return table(spark, d, "orders").select(
        "o_orderkey",
        F.md5(F.to_json(document, S.JSON_OPTIONS)).alias("content_hash"),
        row_hash("o_orderkey", "o_custkey").alias("row_hash"),
    )


@query(
    "document_fields",
    f"""WITH o AS (SELECT *, {_REPORT_CODE} AS code FROM orders)
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'INTERNAL' WHEN o_orderstatus = 'O' THEN 'INTERNAL'
    ELSE {sql_class('code')} END AS pclrty_class,
  CASE WHEN o_orderstatus = 'P' THEN '' WHEN o_orderstatus = 'O' THEN 'A' ELSE code END AS importance_code,
  CASE WHEN o_orderstatus = 'P' THEN '' ELSE 'NX01' END AS vehicle_model FROM o""",
)
def document_fields(spark, d):
    """JSN-3: absent keys, explicit nulls and documents that do not parse."""
    digit = F.substring("o_orderpriority", 1, 1)
    code = F.when(digit == "1", "S").when(digit == "2", "A").when(digit == "3", "B").when(digit == "4", "C")
    prob = F.struct(code.alias("pilot_problem_importnrate_typecd"), security_class(code).alias("pclrty_class"))
    full = F.to_json(F.struct(F.struct(prob.alias("prob")).alias("data")), S.JSON_OPTIONS)
    status = F.col("o_orderstatus")
    content = F.when(status == "P", F.lit("{broken")).when(status == "O", F.lit('{"data":{}}')).otherwise(full)
    docs = table(spark, d, "orders").select("o_orderkey", content.alias("content"))
    return computed_once(docs, ["o_orderkey"], S.document_fields("content"))


_TS = "strftime(ts, '%Y-%m-%d %H:%M:%S.%f')"


def _ts(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def _versions_in(spark, d):
    return table(spark, d, "events").select(
        "user_id", "event_id", F.col("ts").alias("valid_from"), F.col("event_id").alias("seq"),
        F.md5("event_type").alias("content_hash"),
    )


@query(
    "scd2_versions",
    f"""WITH v AS (SELECT event_id, user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx FROM events)
SELECT event_id, user_id, {_TS} AS valid_from, strftime(nx, '%Y-%m-%d %H:%M:%S.%f') AS valid_to, nx IS NULL AS is_latest FROM v""",
)
def scd2_versions(spark, d):
    """SCD-1."""
    out = H.versions(_versions_in(spark, d), "user_id", "valid_from", "seq")
    return out.select("event_id", "user_id", _ts("valid_from").alias("valid_from"), _ts("valid_to").alias("valid_to"), "is_latest")


_BATCHES = "timestamp '2024-01-10'"


@query(
    "scd2_apply",
    f"""WITH v AS (SELECT event_id, user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx FROM events)
SELECT event_id, user_id, {_TS} AS valid_from, strftime(nx, '%Y-%m-%d %H:%M:%S.%f') AS valid_to, nx IS NULL AS is_latest FROM v""",
)
def scd2_apply(spark, d):
    """SCD-1, SNK-5: two batches applied one after the other equal one pass over all versions."""
    rows = _versions_in(spark, d)
    second = F.col("valid_from") >= F.lit("2024-01-10").cast("timestamp_ntz")
    current = materialized(H.versions(rows.where(~second), "user_id", "valid_from", "seq"), "versions")  # a table
    out = H.scd2_apply(current, rows.where(second), "user_id")
    return out.select("event_id", "user_id", _ts("valid_from").alias("valid_from"), _ts("valid_to").alias("valid_to"), "is_latest")


@query(
    "scd2_changed_only",
    f"""WITH c AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pv FROM events),
k AS (SELECT * FROM c WHERE pv IS NULL OR pv <> event_type),
v AS (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx FROM k)
SELECT event_id, user_id, {_TS} AS valid_from, strftime(nx, '%Y-%m-%d %H:%M:%S.%f') AS valid_to, nx IS NULL AS is_latest FROM v""",
)
def scd2_changed_only(spark, d):
    """SCD-2."""
    rows = H.drop_unchanged(_versions_in(spark, d), "user_id", "content_hash", ["valid_from", "seq"])
    out = H.versions(rows, "user_id", "valid_from", "seq")
    return out.select("event_id", "user_id", _ts("valid_from").alias("valid_from"), _ts("valid_to").alias("valid_to"), "is_latest")


@query(
    "scd2_current",
    "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id",
)
def scd2_current(spark, d):
    """SCD-3, FLT-2."""
    out = H.latest(H.versions(_versions_in(spark, d), "user_id", "valid_from", "seq"))
    return out.select("user_id", "event_id")


def _lineage(spark, d):
    """Stage tables at different progress: every table holds a part of what the one before it holds."""
    docs = table(spark, d, "documents")
    labels = table(spark, d, "labels")
    structured = docs.select(
        F.col("doc_id").alias("structured_doc_id"), (F.col("source") != "src7").alias("is_latest"),
        F.col("lang").alias("structured_content"),
    )
    masked = docs.where("lang <> 'de'").select(
        F.col("doc_id").alias("masked_doc_id"), F.col("doc_id").alias("structured_doc_id"),
        (F.col("n_chars") > 1000).alias("is_masked"),
    )

    def chunks(of):
        return of.select(
            (F.col("doc_id") * 3 + F.col("i")).alias("chunk_id"), F.col("doc_id").alias("masked_doc_id")
        )

    seq = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("i")
    chunked = chunks(docs.where("lang <> 'de' AND n_chars > 300").select("doc_id", seq))
    enriched = chunks(labels.where("quality = 1").select("doc_id", seq)).select(
        F.col("chunk_id").alias("enriched_id"), "chunk_id"
    )
    staged = chunks(labels.where("toxic = 1").select("doc_id", seq)).select(
        F.col("chunk_id").alias("staged_id"), F.col("chunk_id").alias("enriched_id")
    )
    return structured, masked, chunked, enriched, staged


_CHUNKED = "SELECT doc_id * 3 + i AS chunk_id, doc_id, source, lang FROM documents, (SELECT unnest([0, 1, 2]) AS i) WHERE lang <> 'de' AND n_chars > 300"


@query(
    "stage_pending",
    "SELECT doc_id AS structured_doc_id FROM documents WHERE source <> 'src7' AND doc_id NOT IN (SELECT doc_id FROM labels)",
)
def stage_pending(spark, d):
    """INC-1, JOIN-3, FLT-2."""
    structured = _lineage(spark, d)[0]
    done = table(spark, d, "labels").select(F.col("doc_id").alias("structured_doc_id"))
    return ST.to_mask(structured, done).select("structured_doc_id")


@query(
    "pending_chunk",
    "SELECT doc_id AS masked_doc_id FROM documents WHERE lang <> 'de' AND n_chars <= 300",
)
def pending_chunk(spark, d):
    """JOIN-4: superseded versions are chunked as well."""
    _, masked, chunked, _, _ = _lineage(spark, d)
    return ST.to_chunk(masked, chunked).select("masked_doc_id")


@query(
    "pending_enrich",
    f"""WITH c AS ({_CHUNKED})
SELECT chunk_id, doc_id AS masked_doc_id, lang AS structured_content FROM c
WHERE source <> 'src7' AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)""",
)
def pending_enrich(spark, d):
    """JOIN-5."""
    structured, masked, chunked, enriched, _ = _lineage(spark, d)
    out = ST.to_enrich(chunked, masked, structured, enriched)
    return out.select("chunk_id", "masked_doc_id", "structured_content")


@query(
    "pending_stage",
    f"""WITH c AS ({_CHUNKED})
SELECT chunk_id AS enriched_id, d.n_chars > 1000 AS is_masked FROM c JOIN documents d USING (doc_id)
WHERE c.source <> 'src7' AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)
  AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""",
)
def pending_stage(spark, d):
    """JOIN-6."""
    structured, masked, chunked, enriched, staged = _lineage(spark, d)
    return ST.to_stage(enriched, chunked, masked, structured, staged).select("enriched_id", "is_masked")


_MASKED_SQL = f"WITH {REPORTS_SQL},\n{sql_masked('reports', 'content', 'doc_id')}"
_TYPES = (("KR_PHONE", "phone"), ("KR_RRN", "rrn"), ("KR_EMAIL", "email"), ("KR_BANK_ACCOUNT", "account"))


def _masked(spark, d):
    return mask_documents(spread_small(reports(spark, d).select("doc_id", "content")), "content")


@query(
    "mask_regex",
    f"{_MASKED_SQL} SELECT doc_id, t AS masked_content, CAST(total AS INTEGER) AS pii_detection_count, is_masked FROM masked",
)
def mask_regex(spark, d):
    """STR-1, AGG-5, AGG-6."""
    return _masked(spark, d).select("doc_id", "masked_content", "pii_detection_count", "is_masked")


_CONTROLS_SQL = f"""WITH {REPORTS_SQL}, odd AS (SELECT doc_id, chr(11) || '010-1234-5678' || chr(1) || 'a.b@example.com' || chr(31) || 'x' || chr(9) || '123456-1234567' || chr(27)
    || content || chr(7) || '01012345678' || chr(10) || '\\u000B' AS content FROM reports),
{sql_masked('odd', 'content', 'doc_id')}
SELECT doc_id, t AS content, CAST(total AS INTEGER) AS pii_detection_count FROM masked"""


@query("mask_stage", _CONTROLS_SQL)
def mask_stage_query(spark, d):
    """STR-1 through the stage: personal data right after control characters that JSON writes as numbers."""
    chars = {n: F.lit(chr(n)) for n in (1, 7, 9, 10, 11, 27, 31)}
    content = F.concat(
        chars[11], F.lit("010-1234-5678"), chars[1], F.lit("a.b@example.com"), chars[31], F.lit("x"), chars[9], F.lit("123456-1234567"),
        chars[27], F.col("content"), chars[7], F.lit("01012345678"), chars[10], F.lit("\\u000B"))
    docs = spread_small(reports(spark, d)).select(
        F.col("doc_id").alias("structured_doc_id"), F.to_json(F.struct(content.alias("content"))).alias("structured_content"))
    out = ST.mask_stage(docs)
    return out.select(
        F.col("structured_doc_id").alias("doc_id"), F.from_json("masked_content", "content string")["content"].alias("content"), "pii_detection_count")


@query(
    "stage_rerun",
    f"{_MASKED_SQL} SELECT doc_id, t AS masked_content, CAST(doc_id % 2 AS INTEGER) AS run FROM masked",
)
def stage_rerun(spark, d):
    """INC-1: a stage run on half its input, then on all of it, then once more: each document is done once, in its run."""
    path = work_path(spark, "stage")
    source = spread_small(reports(spark, d).select("doc_id", "content"))
    schema = StructType.fromDDL("doc_id long, masked_content string, run int")

    def run(number: int, rows: DataFrame) -> DataFrame:
        return ST.run_stage(
            spark, path, schema, lambda done: rows.join(done.select("doc_id"), "doc_id", "left_anti"),
            lambda pending: mask_documents(pending, "content").withColumn("run", F.lit(number)))

    run(0, source.where("doc_id % 2 = 0"))
    run(1, source)
    return run(2, source)


@query(
    "pii_counts",
    _MASKED_SQL
    + " "
    + " UNION ALL ".join(
        f"SELECT doc_id, '{kind}' AS type, CAST({name} AS INTEGER) AS n FROM masked WHERE {name} > 0" for kind, name in _TYPES
    ),
)
def pii_counts(spark, d):
    """STR-1: the per-type counts."""
    out = _masked(spark, d).select("doc_id", F.explode_outer("pii_pattern_types").alias("type", "n"))
    return out.where(F.col("type").isNotNull())


@query(
    "pii_stats",
    f"""{_MASKED_SQL} SELECT 'total' AS type, '전체 감지' AS label, count(*) AS count FROM masked
UNION ALL SELECT 'masked', '마스킹 완료', count(*) FILTER (is_masked) FROM masked
UNION ALL SELECT 'unmasked', '미마스킹', count(*) FILTER (NOT is_masked) FROM masked""",
)
def pii_stats(spark, d):
    """AGG-3, AGG-10, PRJ-7."""
    return stats.stats_rows(stats.masking_stats(_masked(spark, d)))


@query(
    "pii_breakdown",
    _MASKED_SQL
    + ", b AS ("
    + " UNION ALL ".join(
        f"SELECT '{kind}' AS type, CAST(sum({name}) AS BIGINT) AS count FROM masked WHERE is_masked AND {name} > 0"
        for kind, name in _TYPES
    )
    + """) SELECT type, count, CASE type WHEN 'KR_PHONE' THEN '전화번호' WHEN 'KR_RRN' THEN '주민등록번호' ELSE type END AS label
FROM b WHERE count IS NOT NULL""",
)
def pii_breakdown(spark, d):
    """AGG-4, PRJ-4."""
    return stats.type_breakdown(_masked(spark, d))


@query(
    "mask_spans",
    """WITH t AS (SELECT doc_id, text, length(text) AS n FROM documents)
SELECT doc_id, CASE WHEN n > 30 THEN '[KR_NAME]' || substr(text, 6, 25) || '[KR_NAME]' || substr(text, 35)
    ELSE '[KR_NAME]' || substr(text, 6) END AS masked_content,
  CASE WHEN n > 30 THEN 2 ELSE 1 END AS names, CASE WHEN n > 3 THEN 1 ELSE 0 END AS addresses,
  CASE WHEN n > 30 THEN 2 ELSE 1 END + CASE WHEN n > 3 THEN 1 ELSE 0 END AS total FROM t""",
)
def mask_spans(spark, d):
    """UDF-1, AGG-7: overlapping, low-score and unknown spans among those of every document."""
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("masked_content"))
    docs = docs.withColumn("pii_pattern_types", F.create_map().cast("map<string,int>"))
    made = [("PERSON", 0, 5, 0.9), ("LOCATION", 3, 9, 0.7), ("GPE", 20, 25, 0.59), ("PERSON", 30, 34, 0.6), ("DATE", 10, 12, 0.99)]
    rows = F.array(*[
        F.struct(F.lit(k).alias("entity_type"), F.lit(a).alias("start"), F.least(F.lit(b), F.length("masked_content")).alias("end"), F.lit(s).alias("score"))
        for k, a, b, s in made
    ])
    spans = docs.select("doc_id", F.inline(rows)).where("start < `end`")
    out = SP.mask_spans(docs, spans, "doc_id")
    return out.select(
        "doc_id", "masked_content", F.col("pii_pattern_types")["KR_NAME"].alias("names"),
        F.col("pii_pattern_types")["KR_ADDRESS"].alias("addresses"), F.col("pii_detection_count").alias("total"),
    )
