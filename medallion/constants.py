"""Values that results depend on, kept in one place; every operator takes them as default arguments."""

from __future__ import annotations

from dataclasses import dataclass

# --- fixed values: separators -------------------------------------------------------------------
HUB_SEPARATOR = "||"
POLL_SEPARATOR = "|"
LOCATOR_SEPARATOR = ":"

# --- fixed values: importance code -> security class ----------------------------------------------
IMPORTANCE_TO_CLASS = {
    "S": "RESTRICTED",
    "A": "INTERNAL",
    "B": "INTERNAL",
    "C": "INTERNAL",
    "D": "PUBLIC",
    "E": "PUBLIC",
}
DEFAULT_CLASS = "INTERNAL"
DEFAULT_IMPORTANCE = "A"
DEFAULT_MODEL = "NX01"

# --- fixed values: personal-data patterns, in order of application --------------------------------
# (type, pattern, replacement, literal every match contains: texts without it skip the regex)
PII_PATTERNS = (
    ("KR_PHONE", r"\b(01[016789])[-.\s]?\d{3,4}[-.\s]?\d{4}\b", "010****1234", "01"),
    ("KR_RRN", r"\b\d{6}[-]\d{7}\b", "[주민번호 마스킹]", "-"),
    ("KR_EMAIL", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b", "[이메일 마스킹]", "@"),
    ("KR_BANK_ACCOUNT", r"\b\d{3,4}[-]\d{5,7}[-]\d{2}\b", "[계좌번호 마스킹]", "-"),
)
MASKED_THRESHOLD = 4

# --- fixed values: entity tags of the second masking layer ----------------------------------------
ENTITY_TAGS = {"PERSON": "KR_NAME", "LOCATION": "KR_ADDRESS", "GPE": "KR_ADDRESS"}
ENTITY_MIN_SCORE = 0.6
# Fixed value: the method recorded for rows masked by patterns and entity spans.
SPAN_MASKING_METHOD = "presidio_2layer"

# --- fixed values: labels of personal-data types --------------------------------------------------
PII_LABELS = {
    "KR_PHONE": "전화번호",
    "KR_RRN": "주민등록번호",
    "EMAIL": "이메일",
    "NAME": "이름",
    "ADDRESS": "주소",
}
PII_STAT_LABELS = (("total", "전체 감지"), ("masked", "마스킹 완료"), ("unmasked", "미마스킹"))

# --- fixed values: chunking and enrichment --------------------------------------------------------
SECTION_MARKERS = ("현상:", "원인:", "대책:")
CHUNKS_PER_DOCUMENT = 3
EMPTY_CHUNK = "(빈 청크 {})"
CHUNK_METHOD = "section_split"
WORD_PATTERN = r"[가-힣A-Za-z0-9]{2,}"
STOP_WORDS = (
    "이", "가", "을", "를", "의", "에", "은", "는", "과", "와", "도", "로", "으로",
    "에서", "이다", "있다", "하다", "되다", "않다",
)
KNOWN_MODELS = ("NX01", "NX02", "NX03", "GV80", "G90", "IONIQ5", "IONIQ6")
KEYWORDS_PER_CHUNK = 5
SUMMARY_FALLBACK_CHARS = 100

# --- fixed values: change operations --------------------------------------------------------------
STREAM_OPERATIONS = {"c": "insert", "u": "update", "d": "delete", "r": "snapshot"}
LOG_OPERATIONS = {"INSERT": "insert", "UPDATE": "update", "DELETE": "delete"}
FIRST_SIGHT_TTL_DAYS = 7

# --- fixed values: run states ---------------------------------------------------------------------
STAGE_RUN_STATES = {"success": "completed", "running": "in_progress", "failed": "failed"}
LEDGER_RUN_STATES = {"success": "succeeded", "running": "in_progress", "failed": "failed"}
RUNS_PER_DAG = 5

# --- fixed values: search -------------------------------------------------------------------------
RRF_K = 60
CONTENT_BOOST = 2.0
BM25_K1 = 1.2
BM25_B = 0.75
EMBEDDING_DIMS = 384
TITLE_CHARS = 80
HIGHLIGHT_CHARS = 200

# --- fixed values: stages, in order: (id, name, layer) ---------------------------------------------
STAGES = (
    ("ingestion", "데이터 수집", "Bronze"),
    ("bronze_raw", "Bronze 등록", "Bronze"),
    ("silver_structured", "Silver 구조화", "Silver"),
    ("silver_masked", "Silver 마스킹", "Silver"),
    ("gold_chunked", "Gold 청킹", "Gold"),
    ("gold_enriched", "Gold 엔리치먼트", "Gold"),
    ("gold_staged", "Gold Staged", "Gold"),
    ("search_serving", "검색 서빙", "Serving"),
)


@dataclass(frozen=True)
class SourceProfile:
    """Names that belong to one installation: the caller sets them for their own source system."""

    source_name: str = "reports"
    doc_type: str = "report"
    schema_version: str = "1.0"
    table_name: str = "report_history"
    search_index: str = "reports"
    stream_prefix: str = "source.reports."


DEFAULT_PROFILE = SourceProfile()
