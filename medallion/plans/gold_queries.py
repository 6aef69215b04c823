"""Queries over chunking, enrichment, mapping and the dashboard's views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import enrichment as E
from ..functions import mapping as M
from ..functions.chunking import chunk_documents
from ..functions.text import mapped, strip
from ..operators import search_index as IX
from ..operators import stages as ST
from ..operators import stats
from ..operators import tables as T
from ..operators.dictionary import dictionary_entities
from ..session import spread_small
from .gold import class_report, staged_chunks
from .inputs import (
    REPORTS_SQL, SECTIONED_SQL, reports, sectioned, sql_chunks, sql_class, sql_keywords, sql_masked, sql_strip, sql_summary,
)
from .registry import query, table

_MODELS = "'NX01','NX02','NX03','GV80','G90','IONIQ5','IONIQ6'"


def _per_chunk(source: str, keep: str) -> str:
    return f"""{sql_keywords('chunks', 'doc_id, chunk_sequence', 'chunk_content')},
per_chunk AS (SELECT c.doc_id, c.chunk_sequence, coalesce(len(k.keywords), 0) AS nk,
  len(list_filter([{_MODELS}], lambda m: contains(c.chunk_content, m))) AS ne,
  length({sql_summary('c.chunk_content')}) AS ns, length(c.chunk_content) AS nc
  FROM chunks c LEFT JOIN keywords k ON c.doc_id = k.doc_id AND c.chunk_sequence = k.chunk_sequence)"""


@query(
    "gold_class_report",
    f"""WITH {REPORTS_SQL},
{sql_masked('reports', 'content', 'doc_id, code, model')},
{sql_chunks('masked', 'doc_id', 't')},
{_per_chunk('masked', 'doc_id')}
SELECT {sql_class('m.code')} AS pclrty_class, count(*) FILTER (chunk_sequence = 0) AS documents,
  count(*) FILTER (chunk_sequence = 0 AND is_masked) AS masked_documents,
  CAST(sum(CASE WHEN chunk_sequence = 0 THEN total ELSE 0 END) AS BIGINT) AS detections,
  count(*) AS chunks, CAST(sum(nk) AS BIGINT) AS keywords, CAST(sum(ne) AS BIGINT) AS entities,
  CAST(sum(ns) AS BIGINT) AS summary_chars, CAST(sum(nc) AS BIGINT) AS chunk_chars
FROM masked m JOIN per_chunk p ON m.doc_id = p.doc_id GROUP BY 1""",
)
def gold_class_report(spark, d):
    """KEY-1..2, STR-1..8, AGG-5..6, WIN-2, PRJ-3, MAP-1..2 end to end."""
    rows = spread_small(reports(spark, d))
    return class_report(
        staged_chunks(rows, "source", ["pilot_problem_no", "reform_numseq"], "content", "code", "model")
    )


@query(
    "chunk_sections",
    f"""WITH {SECTIONED_SQL}, {sql_chunks('sectioned', 'doc_id', 'content')}
SELECT doc_id, chunk_sequence, chunk_content, CAST(length(chunk_content) AS INTEGER) AS char_count FROM chunks""",
)
def chunk_sections(spark, d):
    """STR-2..5, ARR-1, UDTF-1."""
    out = chunk_documents(spread_small(sectioned(spark, d)), "doc_id", "content")
    return out.select("doc_id", "chunk_sequence", "chunk_content", F.col("chunk_metadata.char_count").alias("char_count"))


@query(
    "chunk_equal",
    f"""WITH src AS (SELECT conv_id * 100000 + turn AS doc_id, text FROM conversations), {sql_chunks('src', 'doc_id', 'text')}
SELECT doc_id, chunk_sequence, chunk_content, CAST(length(chunk_content) AS INTEGER) AS char_count FROM chunks""",
)
def chunk_equal(spark, d):
    """STR-4, STR-5 on every conversation turn."""
    turns = table(spark, d, "conversations").select((F.col("conv_id") * 100000 + F.col("turn")).alias("doc_id"), "text")
    out = chunk_documents(turns, "doc_id", "text")
    return out.select("doc_id", "chunk_sequence", "chunk_content", F.col("chunk_metadata.char_count").alias("char_count"))


@query(
    "keywords_top5",
    f"""WITH {sql_keywords('documents', 'doc_id', 'text')}
SELECT d.doc_id, coalesce(array_to_string(k.keywords, ' '), '') AS keywords FROM documents d LEFT JOIN keywords k USING (doc_id)""",
)
def keywords_top5(spark, d):
    """STR-6, AGG-9, WIN-2 on whole documents."""
    docs = spread_small(table(spark, d, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.array_join(E.keywords(F.col("text")), " ").alias("keywords"))


@query(
    "summary_entities",
    f"""WITH {REPORTS_SQL}, s AS (SELECT doc_id, {sql_strip("content || ' ' || model || ' G90'")} AS t FROM reports)
SELECT doc_id, {sql_summary('t')} AS summary,
  array_to_string(list_filter([{_MODELS}], lambda m: contains(t, m)), ' ') AS entities FROM s""",
)
def summary_entities(spark, d):
    """STR-7, STR-8, JOIN-9."""
    text = strip(F.concat("content", F.lit(" "), "model", F.lit(" G90")))
    rows = reports(spark, d).select("doc_id", text.alias("t"))
    return rows.select("doc_id", E.summary(F.col("t")).alias("summary"), F.array_join(E.entities(F.col("t")), " ").alias("entities"))


@query(
    "entities_dictionary",
    """WITH codes AS (SELECT p_name AS code FROM part UNION SELECT unnest(string_split(p_name, ' ')) FROM part),
found AS (SELECT doc_id, string_agg(code, ',' ORDER BY code) AS entities FROM documents, codes WHERE code <> '' AND contains(text, code) GROUP BY doc_id)
SELECT doc_id, coalesce(entities, '') AS entities FROM documents LEFT JOIN found USING (doc_id)""",
)
def entities_dictionary(spark, d):
    """JOIN-9 with a table as dictionary: part names and their words."""
    parts = table(spark, d, "part").select(F.col("p_name").alias("code"))
    codes = parts.unionByName(parts.select(F.explode(F.split("code", " ")).alias("code")))
    docs = spread_small(table(spark, d, "documents").select("doc_id", "text"))
    return dictionary_entities(docs, "text", codes).select("doc_id", F.array_join("entities", ",").alias("entities"))


@query(
    "enrich_metadata",
    f"""WITH {REPORTS_SQL}, {sql_chunks('reports', 'doc_id', 'content')}, {_per_chunk('reports', 'doc_id')}
SELECT p.doc_id, chunk_sequence, CAST(nk AS INTEGER) AS keyword_count, CAST(ne AS INTEGER) AS entity_count,
  CAST(ns AS INTEGER) AS summary_length, {sql_class('code')} AS pclrty_class, model AS vehicle_model, code AS importance_code
FROM per_chunk p JOIN reports r ON r.doc_id = p.doc_id""",
)
def enrich_metadata(spark, d):
    """MAP-1."""
    rows = spread_small(reports(spark, d)).select("doc_id", "content", "code", "model")
    chunks = chunk_documents(rows, "doc_id", "content")
    out = E.enrich_chunks(chunks, security_class=M.security_class("code"), model=F.col("model"), importance=F.col("code"))
    meta = [F.col(f"enrichment_metadata.{c}").alias(c) for c in (
        "keyword_count", "entity_count", "summary_length", "pclrty_class", "vehicle_model", "importance_code")]
    return out.select("doc_id", "chunk_sequence", *meta)


@query(
    "field_mapping",
    f"""WITH r AS (SELECT o_orderkey, ['S','A','B','C','D','E'][CAST(substr(o_orderpriority, 1, 1) AS INTEGER)] AS code,
  c_mktsegment AS model FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT o_orderkey, {sql_class('code')} AS pclrty_class, 'reports' AS target_index, {sql_class('code')} AS routing,
  'ROLE_' || {sql_class('code')} || ',ROLE_' || model AS role_ids, code AS tag_code, model AS tag_model,
  'reports' AS tag_source, 'report' AS tag_doc_type, 'staged' AS indexing_status FROM r""",
)
def field_mapping(spark, d):
    """PRJ-3, STR-11, MAP-2."""
    codes = F.array(*[F.lit(c) for c in "SABCDE"])
    code = F.get(codes, F.substring("o_orderpriority", 1, 1).cast("int") - 1)
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("model"))
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", code.alias("code")).join(customers, "o_custkey")
    c = ST.staged_columns(F.col("code"), F.col("model"))
    return rows.select(
        "o_orderkey", c["pclrty_class"].alias("pclrty_class"),
        c["es_field_info"]["target_index"].alias("target_index"), c["es_field_info"]["routing"].alias("routing"),
        F.array_join(c["role_ids"], ",").alias("role_ids"),
        c["metadata_tags"]["importance_code"].alias("tag_code"), c["metadata_tags"]["vehicle_model"].alias("tag_model"),
        c["metadata_tags"]["source"].alias("tag_source"), c["metadata_tags"]["doc_type"].alias("tag_doc_type"),
        c["indexing_status"].alias("indexing_status"),
    )


_STAGE_TABLES = (
    ("bronze_raw", "documents", None), ("silver_structured", "events", "event_type <> 'error'"),
    ("silver_masked", "orders", None), ("gold_chunked", "lineitem", None), ("gold_enriched", "pages", None),
    ("gold_staged", "conversations", None),
)


def _stage_counts(spark, d):
    return stats.stage_counts({
        s: (table(spark, d, t) if cond is None else table(spark, d, t).where(cond)) for s, t, cond in _STAGE_TABLES
    })


_STAGE_SQL = " UNION ALL ".join(
    f"SELECT '{s}' AS stage, count(*) AS docs_in, count(*) AS docs_out FROM {t}" + (f" WHERE {c}" if c else "")
    for s, t, c in _STAGE_TABLES
)


@query("stage_counts", _STAGE_SQL)
def stage_counts(spark, d):
    """AGG-1, SET-1."""
    return _stage_counts(spark, d)


_META = (
    "(VALUES ('ingestion', 0, 'Bronze'), ('bronze_raw', 1, 'Bronze'), ('silver_structured', 2, 'Silver'), "
    "('silver_masked', 3, 'Silver'), ('gold_chunked', 4, 'Gold'), ('gold_enriched', 5, 'Gold'), ('gold_staged', 6, 'Gold'), "
    "('search_serving', 7, 'Serving')) AS m(id, index, layer)"
)


@query(
    "active_stages",
    f"""WITH c AS ({_STAGE_SQL}), e AS (
  SELECT event_type, arg_max(event_id, (ts, event_id)) AS id FROM events GROUP BY 1),
r AS (SELECT CASE e.event_type WHEN 'click' THEN 'bronze_raw' WHEN 'view' THEN 'silver_structured'
  WHEN 'purchase' THEN 'gold_staged' WHEN 'signup' THEN 'search_serving' ELSE 'none' END AS stage,
  CASE id % 4 WHEN 0 THEN 'completed' WHEN 1 THEN 'in_progress' WHEN 2 THEN 'failed' ELSE 'none' END AS status FROM e)
SELECT m.id, CAST(m.index AS INTEGER) AS index, m.layer, coalesce(r.status, 'none') AS status,
  coalesce(c.docs_in, 0) AS docs_in, coalesce(c.docs_out, 0) AS docs_out
FROM {_META} LEFT JOIN c ON c.stage = m.id LEFT JOIN r ON r.stage = m.id WHERE m.id <> 'search_serving'""",
)
def active_stages(spark, d):
    """JOIN-12, FLT-9, WIN-3."""
    from ..operators.runs import latest_runs
    from .run_queries import ledger

    runs = latest_runs(ledger(spark, d))
    dag = F.col("dag_id")
    stage = (
        F.when(dag == "click", "bronze_raw").when(dag == "view", "silver_structured")
        .when(dag == "purchase", "gold_staged").when(dag == "signup", "search_serving").otherwise("none")
    )
    view = stats.stage_view(_stage_counts(spark, d), runs.select(stage.alias("stage"), "status", "last_run_at", "duration_ms"))
    return stats.active_stages(view).select("id", "index", "layer", "status", "docs_in", "docs_out")


def _rollup_tables(spark, d):
    """Stage tables in which a hub (source and language) has many documents of three chunks each."""
    docs = table(spark, d, "documents")
    labels = table(spark, d, "labels")
    hub_key = F.concat_ws("/", "source", "lang")
    hub = docs.select(hub_key.alias("document_hub_hash_key"), hub_key.alias("source_primary_key")).distinct()
    content = F.concat(F.lit('{"data":{"title":"'), "lang", F.lit(" "), F.col("n_chars").cast("string"), F.lit('"}}'))
    structured = docs.select(
        F.col("doc_id").alias("structured_doc_id"), hub_key.alias("document_hub_hash_key"), content.alias("structured_content")
    )
    flags = labels.select("doc_id", (F.col("quality") == 1).alias("q"))
    masked = docs.join(flags, "doc_id", "left").select(
        F.col("doc_id").alias("masked_doc_id"), F.col("doc_id").alias("structured_doc_id"),
        F.coalesce("q", F.lit(True)).alias("is_masked"),
        F.create_map(F.lit("KR_PHONE"), (F.col("n_chars") % 7).cast("int")).alias("pii_pattern_types"),
    )
    seq = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("i")
    ids = docs.select("doc_id", "lang", seq).withColumn("id", F.col("doc_id") * 3 + F.col("i"))
    chunked = ids.select(F.col("id").alias("chunk_id"), F.col("doc_id").alias("masked_doc_id"))
    enriched = ids.select(F.col("id").alias("enriched_id"), F.col("id").alias("chunk_id"))
    code = F.get(F.array(*[F.lit(c) for c in "SABCDE"]), (F.col("doc_id") % 6).cast("int"))
    cls = M.security_class(code)
    staged = ids.select(
        F.col("id").alias("staged_id"), F.col("id").alias("enriched_id"), cls.alias("pclrty_class"),
        M.search_field_info(cls).alias("es_field_info"),
    )
    return staged, enriched, chunked, masked, structured, hub


_ROLLUP_SQL = f"""x AS (SELECT d.source || '/' || d.lang AS doc_id, {sql_class("['S','A','B','C','D','E'][d.doc_id % 6 + 1]")} AS cls,
  coalesce(l.quality = 1, true) AS is_masked, '{{"KR_PHONE":' || CAST(n_chars % 7 AS VARCHAR) || '}}' AS pii,
  '{{"data":{{"title":"' || lang || ' ' || CAST(n_chars AS VARCHAR) || '"}}}}' AS content
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
rollup_rows AS (SELECT doc_id, doc_id AS source_primary_key, min(cls) AS pclrty_class,
  min('{{"target_index":"reports","routing":"' || cls || '"}}') AS es_field_info, bool_and(is_masked) AS is_masked,
  min(pii) AS pii_pattern_types, min(content) AS structured_content FROM x GROUP BY doc_id)"""


@query("document_rollup", f"WITH {_ROLLUP_SQL} SELECT * FROM rollup_rows")
def document_rollup(spark, d):
    """AGG-2, JOIN-8."""
    return stats.document_rollup(*_rollup_tables(spark, d))


@query(
    "document_filter",
    f"""WITH {_ROLLUP_SQL}
SELECT doc_id AS id, substr(structured_content, 19, strpos(structured_content, '"}}') - 19) AS title, 'B' AS priority,
  pclrty_class AS security, 'NX01' AS "vehicleModel", is_masked AS masked, 'KR_PHONE' AS type, '전화번호' AS label,
  CAST(substr(pii_pattern_types, 13, 1) AS INTEGER) AS count FROM rollup_rows
WHERE is_masked AND pclrty_class = 'INTERNAL'""",
)
def document_filter(spark, d):
    """PRJ-6, MAP-3, FLT-4."""
    rollup = stats.document_rollup(*_rollup_tables(spark, d))
    codes = {"RESTRICTED": "S", "INTERNAL": "B", "PUBLIC": "D"}
    view = stats.document_view(rollup, mapped("pclrty_class", codes, "C"))
    shown = stats.filter_documents(view, priority="B", masked_only=True)
    return shown.select("id", "title", "priority", "security", "vehicleModel", "masked", F.inline_outer("piiCounts"))


@query(
    "document_totals",
    f"""WITH {_ROLLUP_SQL} SELECT count(*) FILTER (is_masked) AS masked, count(*) FILTER (NOT is_masked) AS unmasked,
  count(*) AS total FROM rollup_rows""",
)
def document_totals(spark, d):
    """AGG-10."""
    return stats.masking_stats(stats.document_rollup(*_rollup_tables(spark, d)))


@query(
    "mark_indexed",
    """SELECT d.doc_id AS staged_id, CASE WHEN l.doc_id IS NOT NULL OR lang = 'de' THEN 'indexed' ELSE 'staged' END AS indexing_status
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
)
def mark_indexed(spark, d):
    """SNK-7: rows that were indexed before stay so."""
    status = F.when(F.col("lang") == "de", F.lit("indexed")).otherwise(F.lit("staged"))
    staged = table(spark, d, "documents").select(F.col("doc_id").alias("staged_id"), status.alias("indexing_status"))
    return ST.mark_indexed(staged, table(spark, d, "labels").select(F.col("doc_id").alias("staged_id")))


def _index_rows(spark, d):
    """Staged, enriched and chunk tables; some class, tag and content values are NULL."""
    docs = table(spark, d, "documents")
    code = F.get(F.array(*[F.lit(c) for c in "SABCDE"]), (F.col("doc_id") % 6).cast("int"))
    cls = F.when(F.col("lang") != "es", M.security_class(code))
    staged = docs.select(
        F.col("doc_id").alias("staged_id"), F.col("doc_id").alias("enriched_id"),
        F.when(F.col("lang") != "fr", M.search_field_info(cls)).alias("es_field_info"),
        M.role_ids(cls, F.col("lang")).alias("role_ids"), M.metadata_tags(cls, code, F.col("lang")).alias("metadata_tags"),
        cls.alias("pclrty_class"),
        F.when(F.col("source") == "src1", F.lit("indexed")).otherwise(F.lit("staged")).alias("indexing_status"),
    )
    enriched = docs.select(
        F.col("doc_id").alias("enriched_id"), F.col("doc_id").alias("chunk_id"),
        F.array(F.col("lang"), F.col("source")).alias("keywords"), F.array().cast("array<string>").alias("entities"),
        F.when(F.col("lang") != "de", F.substring("text", 1, 40)).alias("summary"), F.col("source").alias("category"),
    )
    chunked = docs.select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("chunk_content"))
    return staged, enriched, chunked


_CLS = sql_class("['S','A','B','C','D','E'][doc_id % 6 + 1]")


@query(
    "index_source",
    f"""WITH c AS (SELECT *, CASE WHEN lang <> 'es' THEN {_CLS} END AS cls FROM documents WHERE source <> 'src1')
SELECT doc_id AS staged_id, md5(text) AS content_md5, lang || ',' || source AS keywords,
  CASE WHEN lang <> 'de' THEN substr(text, 1, 40) ELSE '' END AS summary, source AS category, coalesce(cls, '') AS pclrty_class,
  coalesce(cls, 'INTERNAL') AS routing FROM c""",
)
def index_source(spark, d):
    """JOIN-7, FLT-3, IDX-1, IDX-2, JSN-5, JSN-6."""
    docs = IX.search_documents(ST.to_index(*_index_rows(spark, d)))
    return docs.select(
        "staged_id", F.md5("chunk_content").alias("content_md5"), F.array_join("keywords", ",").alias("keywords"),
        "summary", "category", "pclrty_class", "routing",
    )


@query(
    "upsert_index",
    f"""WITH c AS (SELECT *, CASE WHEN lang <> 'es' THEN {_CLS} END AS cls FROM documents)
SELECT doc_id AS staged_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'PUBLIC' ELSE coalesce(cls, 'INTERNAL') END AS routing,
  CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN upper(source) ELSE source END AS category
FROM c WHERE source <> 'src1' OR doc_id IN (SELECT doc_id FROM labels)""",
)
def upsert_index(spark, d):
    """SNK-6: the labelled documents come again, twice, with another class; the last one counts."""
    staged, enriched, chunked = _index_rows(spark, d)
    existing = IX.search_documents(ST.to_index(staged, enriched, chunked)).select("staged_id", "routing", "category")
    again = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")
    first = again.select(F.col("doc_id").alias("staged_id"), F.lit("RESTRICTED").alias("routing"), "source", F.lit(1).alias("v"))
    second = first.withColumns({"routing": F.lit("PUBLIC"), "v": F.lit(2), "source": F.upper("source")})
    incoming = first.unionByName(second).withColumnRenamed("source", "category")
    return T.upsert(existing, incoming, ["staged_id"], ["v"])
