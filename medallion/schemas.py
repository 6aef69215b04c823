"""Schemas of every table; reads never infer one."""

from __future__ import annotations

from pyspark.sql import types as T

S, I, L, B, D, TS = (
    T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType(), T.DoubleType(), T.TimestampType(),
)


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


PART = _struct(part_no=S, part_name=S, manfproc_typecd=S)
STEP = _struct(pilot_step_typecd=S, step_name=S, step_date=S)
PARTS = T.ArrayType(PART)
STEPS = T.ArrayType(STEP)

# Source report as it lies in a Bronze batch file: arrays as JSON, dates as strings.
REPORT = _struct(
    pilot_problem_no=S, reform_numseq=I, pilot_project_no=S, pilot_vhclmodel_no=S, pilot_step_typecd=S,
    pilot_problem_importnrate_typecd=S, pclrty_class=S, problem_content=S, cntmeasure_content=S,
    display_content=S, dept_name=S, reg_empno=S, upd_empno=S, reg_dts=S, upd_dts=S, parts=S, steps=S, row_hash=S,
)
REPORT_DEFAULTS = {
    "pilot_problem_importnrate_typecd": "A", "pclrty_class": "INTERNAL", "problem_content": "",
    "cntmeasure_content": "", "display_content": "", "pilot_vhclmodel_no": "NX01", "parts": "[]", "steps": "[]",
}

HUB = _struct(document_hub_hash_key=S, source_name=S, source_primary_key=S, record_load_dts=TS)
EVENT = _struct(
    bronze_rdb_event_id=S, table_name=S, batch_id=S, s3_path=S, record_count=L, change_operation=S, event_dts=TS,
)
LINK = _struct(rdb_link_hash_key=S, document_hub_hash_key=S, bronze_rdb_event_id=S)
SATELLITE = _struct(
    assembly_sat_hash_key=S, document_hub_hash_key=S, document_type=S, assembly_status=S, retry_count=I,
    record_load_dts=TS,
)

STRUCTURED = _struct(
    source=S, doc_type=S, schema_version=S,
    data=_struct(
        prob=_struct(
            pilot_problem_no=S, reform_numseq=I, pilot_problem_importnrate_typecd=S, pclrty_class=S,
            problem_content=S, cntmeasure_content=S,
        ),
        step=STEPS, part=PARTS, vehiclefuse=_struct(pilot_vhclmodel_no=S),
    ),
    display=_struct(display_content=S, dept_name=S, manager_name=S),
)
STRUCTURED_DOCUMENT = _struct(
    structured_doc_id=S, document_hub_hash_key=S, structured_content=S, content_format=S, structuring_method=S,
    content_hash=S, valid_from=TS, seq=L, valid_to=TS, is_latest=B,
)
MASKED = _struct(
    masked_doc_id=S, structured_doc_id=S, masked_content=S, pii_pattern_types=T.MapType(S, I),
    pii_detection_count=I, is_masked=B, masking_method=S,
)
CHUNK = _struct(
    chunk_id=S, masked_doc_id=S, chunk_sequence=I, chunk_content=S,
    chunk_metadata=_struct(doc_id=S, sequence=I, char_count=I, chunk_method=S),
)
ENRICHED = _struct(
    enriched_id=S, chunk_id=S, keywords=T.ArrayType(S), entities=T.ArrayType(S), summary=S, category=S,
    enrichment_metadata=_struct(
        chunk_id=S, keyword_count=I, entity_count=I, summary_length=I, pclrty_class=S, vehicle_model=S,
        importance_code=S,
    ),
)
STAGED = _struct(
    staged_id=S, enriched_id=S, es_field_info=_struct(target_index=S, routing=S), role_ids=T.ArrayType(S),
    metadata_tags=T.MapType(S, S), pclrty_class=S, indexing_status=S,
)

ENVELOPE = _struct(
    payload=_struct(before=S, after=S, op=S, ts_ms=L, source=_struct(table=S)),
)
STREAM_ENTRY = _struct(stream_key=S, msg_id=S, value=S)
CHANGE_LOG = _struct(
    id=L, operation=S, pilot_problem_no=S, reform_numseq=I, changed_at=TS, processed=B,
)
SEARCH_RESULT = _struct(
    staged_id=S, chunk_content=S, summary=S, category=S, pclrty_class=S, metadata_tags=T.MapType(S, S),
    score=D, keyword_score=D, semantic_score=D,
)

# Columns that must not be NULL, and the parent each key points to: (child, key, parent).
REQUIRED = {
    "hub": ["document_hub_hash_key", "source_name", "source_primary_key"],
    "event": ["table_name", "batch_id", "s3_path", "record_count", "change_operation"],
    "link": ["rdb_link_hash_key", "document_hub_hash_key", "bronze_rdb_event_id"],
    "structured": ["document_hub_hash_key", "structured_content"],
    "masked": ["structured_doc_id", "masked_content"],
    "chunked": ["masked_doc_id", "chunk_content", "chunk_sequence"],
}
PRIMARY_KEYS = {
    "hub": "document_hub_hash_key", "event": "bronze_rdb_event_id", "link": "rdb_link_hash_key",
    "satellite": "assembly_sat_hash_key", "structured": "structured_doc_id", "masked": "masked_doc_id",
    "chunked": "chunk_id", "enriched": "enriched_id", "staged": "staged_id",
}
FOREIGN_KEYS = (
    ("link", "document_hub_hash_key", "hub"), ("link", "bronze_rdb_event_id", "event"),
    ("satellite", "document_hub_hash_key", "hub"), ("structured", "document_hub_hash_key", "hub"),
    ("masked", "structured_doc_id", "structured"), ("chunked", "masked_doc_id", "masked"),
    ("enriched", "chunk_id", "chunked"), ("staged", "enriched_id", "enriched"),
)
