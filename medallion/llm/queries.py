"""The operators' queries over the test tables, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_text, licenses, near_dup, ngram_lm, packing, pii, quality, sequences, sharding
from .common import table, text_of

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_token_files")
def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of whole texts written to Arrow stream files and read back, per document."""
    return sequences.read_documents(sequences.write_sequences(table(spark, sf_dir, "documents")))


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10ffff}]+')"

OP2_SQL = f"""WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
i0 AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS ws FROM benchmark),
i1 AS (SELECT item, ws, least(10, len(ws)) AS size FROM i0 WHERE len(ws) > 0),
i2 AS (SELECT DISTINCT item, size, array_to_string(ws[p:p + size - 1], ' ') AS gram
  FROM (SELECT item, ws, size, unnest(range(1, len(ws) - size + 2)) AS p FROM i1)),
sizes AS (SELECT DISTINCT size FROM i2),
g AS (SELECT doc_id, size, p, array_to_string(ws[p:p + size - 1], ' ') AS gram
  FROM (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS p FROM d, sizes WHERE len(ws) >= size)),
h AS (SELECT doc_id, item, p, g.size FROM g JOIN i2 ON g.gram = i2.gram AND g.size = i2.size),
hits AS (SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + size)) AS w FROM h) GROUP BY 1),
own AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1)
SELECT d.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits ON d.doc_id = hits.doc_id LEFT JOIN own ON d.doc_id = own.doc_id"""


@query("op2_decontaminate", OP2_SQL)
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of test items inside each document."""
    found = decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    return found.select(
        F.col("c0").alias("doc_id"), "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP3_SQL = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
w AS (SELECT doc_id, p, ws[p:p + 2] AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS p FROM d WHERE len(ws) >= 3)),
again AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, win) AS n FROM w) WHERE n > 1),
inside AS (SELECT doc_id, count(DISTINCT p + k) AS n FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY 1),
m AS (SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    coalesce(n, 0) AS n_repeat_words FROM d LEFT JOIN inside ON d.doc_id = inside.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 10 * n_symbols <= n_words
    AND word_chars BETWEEN 3 * n_words AND 10 * n_words AND 10 * n_dup_lines <= 8 * n_lines AS kept
FROM m"""


@query("op3_quality_rules", OP3_SQL)
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base counts of each document and the cascade's verdict."""
    docs = table(spark, sf_dir, "documents")
    rules = quality.order_rules(docs)
    judged = quality.judge(docs, ["doc_id"], rules, measures=True)
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.select(
        F.col("c0").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (F.col("rejected_by").isNull() & ~base).alias("kept"))


@query("op5_best_fit_packing")
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces, placed in sequences of at most 4096 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query("op6_uniform_shards")
def op6_uniform_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents shuffled into 16 shards whose row counts are at most one apart."""
    docs = table(spark, sf_dir, "documents")
    text = text_of(docs).cast("binary")
    digest = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return sharding.shuffle(digest).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op9_main_text")
def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article of every page."""
    texts = html_text.main_texts(table(spark, sf_dir, "pages"), ["page_id", "url"])
    return texts.select(F.col("c0").alias("page_id"), F.col("c1").alias("url"), "text", F.char_length("text").cast("long").alias("n_chars"))


@query("op10_licenses")
def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence sentences of each document in order, and the licences their sequence names."""
    found = licenses.scan(table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select(
        F.col("c0").alias("doc_id"), F.size("sentence_ids").cast("long").alias("n_sentences"),
        F.concat_ws(",", "sentence_ids").alias("sentence_ids"), F.size("licenses").cast("long").alias("n_licenses"),
        F.concat_ws(",", "licenses").alias("licenses"))


@query("op8_personal_data")
def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in each document, the base kinds' counts and digest."""
    found = pii.find(table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select(
        F.col("c0").alias("doc_id"), *(pii.count_kind(F.col("base"), k).alias(f"n_{k}") for k in pii.KINDS),
        F.sha2("base", 256).alias("base_sha256"), "spans")


@query("op7_near_duplicates")
def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class of near-duplicates, named by its least doc_id."""
    found = near_dup.classes(table(spark, sf_dir, "documents"))
    return found.select(F.col("key").alias("doc_id"), "class_id", F.col("key").eqNullSafe(F.col("class_id")).alias("kept"))


OP4_SQL = f"""WITH d AS (SELECT doc_id, len({_WORDS}) AS n_words, {_WORDS} AS ws FROM documents),
total AS (SELECT CAST(sum(n_words) AS BIGINT) AS n FROM d),
p AS (SELECT doc_id, n_words, i, ws[i] AS g1, CASE WHEN i > 1 THEN ws[i - 1] || ' ' || ws[i] END AS g2,
    CASE WHEN i > 2 THEN ws[i - 2] || ' ' || ws[i - 1] || ' ' || ws[i] END AS g3,
    CASE WHEN i > 1 THEN ws[i - 1] END AS c1, CASE WHEN i > 2 THEN ws[i - 2] || ' ' || ws[i - 1] END AS c2
  FROM (SELECT doc_id, n_words, ws, unnest(range(1, n_words + 1)) AS i FROM d)),
grams AS (SELECT doc_id, g, count(*) AS own FROM (SELECT doc_id, g1 AS g FROM p UNION ALL SELECT doc_id, g2 FROM p UNION ALL SELECT doc_id, g3 FROM p)
  WHERE g IS NOT NULL GROUP BY ALL),
held AS (SELECT doc_id, g, CAST(sum(own) OVER (PARTITION BY g) AS BIGINT) - own AS n FROM grams),
q AS (SELECT p.*, (SELECT n FROM total) - n_words AS rest, h1.n AS n1, h2.n AS n2, h3.n AS n3, k1.n AS m1, k2.n AS m2 FROM p
  LEFT JOIN held h1 ON h1.doc_id = p.doc_id AND h1.g = g1 LEFT JOIN held h2 ON h2.doc_id = p.doc_id AND h2.g = g2
  LEFT JOIN held h3 ON h3.doc_id = p.doc_id AND h3.g = g3 LEFT JOIN held k1 ON k1.doc_id = p.doc_id AND k1.g = c1
  LEFT JOIN held k2 ON k2.doc_id = p.doc_id AND k2.g = c2),
s AS (SELECT doc_id, least(i, 3) AS possible, CASE WHEN n3 > 0 THEN 3 WHEN n2 > 0 THEN 2 ELSE 1 END AS level,
    CASE WHEN n3 > 0 THEN CAST(n3 AS DOUBLE) / m2 WHEN n2 > 0 THEN CAST(n2 AS DOUBLE) / m1
      WHEN n1 > 0 THEN CAST(n1 AS DOUBLE) / rest ELSE 1.0 / (rest + 1) END AS ratio FROM q),
t AS (SELECT doc_id, CAST(sum(CAST(round((ln(ratio) + (possible - level) * ln(CAST(0.4 AS DOUBLE))) * 1000000) AS BIGINT)) AS BIGINT) AS score_micro,
    count_if(level = possible) AS n_full FROM s GROUP BY 1)
SELECT d.doc_id, CAST(n_words AS BIGINT) AS n_words, coalesce(score_micro, 0) AS score_micro, CAST(coalesce(n_full, 0) AS BIGINT) AS n_full
FROM d LEFT JOIN t ON d.doc_id = t.doc_id"""


@query("op4_lm_scores", OP4_SQL)
def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stupid-backoff score of every document by the trigram counts of all others."""
    return ngram_lm.score(table(spark, sf_dir, "documents"))
