"""The pipeline's inputs read off the test tables, and the same definitions as SQL.

``documents`` stand in for report texts.  They hold e-mail addresses but no phone, resident or account
numbers and no section markers, so those are added from the row's own columns, on both sides alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import table

CODES = ("S", "A", "B", "C", "D", "E", "X")
LOAD_TS = "2026-01-02 03:04:05"

# Unicode white space as SQL regex class.
SQL_SPACE = (
    r"[\t\n\x0b\f\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)


def sql_strip(expression: str) -> str:
    return f"regexp_replace({expression}, '^{SQL_SPACE}+|{SQL_SPACE}+$', '', 'g')"


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report rows: key, importance code, model and content with personal data."""
    docs = table(spark, sf_dir, "documents")
    phone = F.concat(F.lit(" tel 010-"), F.lpad((F.col("doc_id") % 10000).cast("string"), 4, "0"), F.lit("-5678"))
    ids = F.lit(" id 901231-1234567 acct 110-123456-78")
    mail = F.concat(F.lit(" mail user"), F.col("doc_id").cast("string"), F.lit("@mail.example"))
    kind = F.col("doc_id") % 4
    extra = (
        F.when(kind == 0, F.lit(""))
        .when(kind == 1, F.concat(phone, F.lit(" end")))
        .when(kind == 2, F.concat(phone, ids, F.lit(" end")))
        .otherwise(F.concat(phone, ids, mail, F.lit(" end")))
    )
    return docs.select(
        "doc_id",
        F.concat(F.lit("AP"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("pilot_problem_no"),
        F.lit(1).alias("reform_numseq"),
        F.get(F.array(*[F.lit(c) for c in CODES]), (F.col("doc_id") % len(CODES)).cast("int")).alias("code"),
        F.concat(F.lit("NX0"), (F.col("doc_id") % 3 + 1).cast("string")).alias("model"),
        "source",
        "lang",
        F.concat("text", extra).alias("content"),
    )


_CODE_CASE = " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CODES))
_PHONE = "' tel 010-' || lpad(CAST(doc_id % 10000 AS VARCHAR), 4, '0') || '-5678'"
_IDS = "' id 901231-1234567 acct 110-123456-78'"
_MAIL = "' mail user' || CAST(doc_id AS VARCHAR) || '@mail.example'"

REPORTS_SQL = f"""reports AS (
  SELECT doc_id, 'AP' || lpad(CAST(doc_id AS VARCHAR), 12, '0') AS pilot_problem_no, 1 AS reform_numseq,
    CASE doc_id % 7 {_CODE_CASE} END AS code,
    'NX0' || CAST(doc_id % 3 + 1 AS VARCHAR) AS model, source, lang,
    text || CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN {_PHONE} || ' end'
      WHEN 2 THEN {_PHONE} || {_IDS} || ' end' ELSE {_PHONE} || {_IDS} || {_MAIL} || ' end' END AS content
  FROM documents)"""

# The patterns and replacements of the masking rules, for the SQL side.
_PATTERNS = (
    ("phone", r"\b(01[016789])[-.\s]?\d{3,4}[-.\s]?\d{4}\b", "010****1234"),
    ("rrn", r"\b\d{6}[-]\d{7}\b", "[주민번호 마스킹]"),
    ("email", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b", "[이메일 마스킹]"),
    ("account", r"\b\d{3,4}[-]\d{5,7}[-]\d{2}\b", "[계좌번호 마스킹]"),
)


def sql_masked(source: str, text: str, keep: str) -> str:
    """CTEs ``m0..m4``: counts per pattern and the text after each; ``masked`` has totals and flag."""
    ctes = [f"m0 AS (SELECT {keep}, {text} AS t FROM {source})"]
    names = []
    for i, (name, pattern, replacement) in enumerate(_PATTERNS):
        ctes.append(
            f"m{i + 1} AS (SELECT * EXCLUDE (t), len(regexp_extract_all(t, '{pattern}')) AS {name}, "
            f"regexp_replace(t, '{pattern}', '{replacement}', 'g') AS t FROM m{i})"
        )
        names.append(name)
    total = " + ".join(names)
    ctes.append(f"masked AS (SELECT *, {total} AS total, {total} >= 4 AS is_masked FROM m{len(_PATTERNS)})")
    return ",\n".join(ctes)


def sectioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with none, two or three section markers, in and out of order, with and without a lead."""
    docs = table(spark, sf_dir, "documents")
    kind = F.col("doc_id") % 6
    full = F.concat(F.lit("현상: "), "text", F.lit(" 원인: "), "source", F.lit(" 대책: "), "lang")
    content: Column = (
        F.when(kind == 0, F.col("text"))
        .when(kind == 1, full)
        .when(kind == 2, F.concat(F.lit("intro "), full))
        .when(kind == 3, F.concat(F.lit("intro 현상: "), "text", F.lit(" 대책: "), "lang"))
        .when(kind == 4, F.concat(F.lit("대책: "), "lang", F.lit(" 현상: "), "text"))
        .otherwise(F.concat(F.lit("  　 "), "text", F.lit(" \n ")))
    )
    return docs.select("doc_id", content.alias("content"))


SECTIONED_SQL = """sectioned AS (
  SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN text
    WHEN 1 THEN '현상: ' || text || ' 원인: ' || source || ' 대책: ' || lang
    WHEN 2 THEN 'intro 현상: ' || text || ' 원인: ' || source || ' 대책: ' || lang
    WHEN 3 THEN 'intro 현상: ' || text || ' 대책: ' || lang
    WHEN 4 THEN '대책: ' || lang || ' 현상: ' || text
    ELSE '  ' || chr(12288) || ' ' || text || ' ' || chr(10) || ' ' END AS content
  FROM documents)"""


def sql_chunks(source: str, doc: str, text: str) -> str:
    """CTE ``chunks(doc, chunk_sequence, chunk_content)`` by the chunking rules."""
    part = "substr(t, {0} * size + 1, size)"
    return f"""c0 AS (SELECT {doc}, {sql_strip(text)} AS t FROM {source}),
c1 AS (SELECT *, list_sort(list_filter([strpos(t, '현상:'), strpos(t, '원인:'), strpos(t, '대책:')], lambda p: p > 0)) AS p,
  greatest(1, length(t) // 3) AS size FROM c0),
c2 AS (SELECT *, CASE WHEN p[1] > 1 THEN list_concat([CAST(1 AS BIGINT)], p) ELSE p END AS st FROM c1),
c3 AS (SELECT {doc}, CASE WHEN len(st) >= 3 THEN
    list_transform(range(1, len(st) + 1), lambda i: substr(t, st[i], coalesce(st[i + 1], length(t) + 1) - st[i]))
  ELSE [{part.format(0)}, {part.format(1)}, substr(t, 2 * size + 1)] END AS parts FROM c2),
c4 AS (SELECT {doc}, CAST(unnest(range(0, len(parts))) AS INTEGER) AS chunk_sequence, unnest(parts) AS raw FROM c3),
chunks AS (SELECT {doc}, chunk_sequence, CASE WHEN {sql_strip('raw')} = ''
  THEN '(빈 청크 ' || CAST(chunk_sequence + 1 AS VARCHAR) || ')' ELSE {sql_strip('raw')} END AS chunk_content FROM c4)"""


# The stop words, for the SQL side.
_STOP = (
    "'이','가','을','를','의','에','은','는','과','와','도','로','으로','에서','이다','있다','하다','되다','않다'"
)


def sql_keywords(source: str, ids: str, text: str) -> str:
    """CTE ``keywords(ids, keywords)``: the five most frequent words, ties by first appearance."""
    return f"""k0 AS (SELECT {ids}, regexp_extract_all({text}, '[가-힣A-Za-z0-9]{{2,}}') AS ws FROM {source}),
k1 AS (SELECT {ids}, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM k0),
k2 AS (SELECT {ids}, w, count(*) AS n, min(i) AS i FROM k1 WHERE w NOT IN ({_STOP}) GROUP BY ALL),
k3 AS (SELECT *, row_number() OVER (PARTITION BY {ids} ORDER BY n DESC, i) AS r FROM k2),
keywords AS (SELECT {ids}, list(w ORDER BY r) AS keywords FROM k3 WHERE r <= 5 GROUP BY ALL)"""


def sql_summary(text: str) -> str:
    first = sql_strip(f"split_part({text}, '.', 1)")
    return f"CASE WHEN {first} <> '' THEN {first} ELSE substr({text}, 1, 100) END"


def sql_class(code: str) -> str:
    return (
        f"CASE {code} WHEN 'S' THEN 'RESTRICTED' WHEN 'A' THEN 'INTERNAL' WHEN 'B' THEN 'INTERNAL' "
        f"WHEN 'C' THEN 'INTERNAL' WHEN 'D' THEN 'PUBLIC' WHEN 'E' THEN 'PUBLIC' ELSE 'INTERNAL' END"
    )
