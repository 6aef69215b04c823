"""Queries of the operators on pieces, manifests and conversations, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, merkle, sentence_pieces
from .common import table
from .queries import query


@query("op11_sentence_pieces")
def op11_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of whole texts and the text of the ids; ``agrees``: as the library on every cut."""
    found = sentence_pieces.encode_documents(table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select(
        F.col("c0").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"), "agrees")


_LEAF = ("doc_id", "source", "lang", "n_chars", "text")
_SQL_FIELD = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || {0}, '-')"


def _sql_leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_SQL_FIELD.format(n_chars if f == "n_chars" else f) for f in _LEAF) + ")"


_SQL_CRC = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
    lambda a, c: list_reduce([xor(a, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))))"""

OP12_SQL = f"""WITH RECURSIVE l AS (SELECT doc_id, lang, {_sql_leaf('n_chars')} AS leaf,
    CASE WHEN doc_id IS NOT NULL AND {_SQL_CRC} % 7 = 0 THEN {_sql_leaf('(n_chars + 1)')} ELSE {_sql_leaf('n_chars')} END AS checked FROM documents),
d AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n FROM l),
nodes AS (SELECT lang, 0 AS lvl, idx, n, leaf AS h FROM d
  UNION ALL SELECT lang, lvl + 1, idx // 2, (max(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM nodes WHERE n > 1 GROUP BY lang, lvl, idx // 2),
tops AS (SELECT lang, lvl, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1),
upper AS (SELECT 0 AS lvl, idx, n, subroot AS h FROM tops
  UNION ALL SELECT lvl + 1, idx // 2, (max(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM upper WHERE n > 1 GROUP BY lvl, idx // 2),
steps AS (SELECT d.doc_id, d.lang, d.idx, s.lvl, s.h, s.idx % 2 AS behind FROM d JOIN nodes s ON s.lang IS NOT DISTINCT FROM d.lang AND s.n > 1 AND s.idx = xor(d.idx >> s.lvl, 1)
  UNION ALL SELECT d.doc_id, d.lang, d.idx, t.lvl + s.lvl, s.h, s.idx % 2 FROM d JOIN tops t ON t.lang IS NOT DISTINCT FROM d.lang JOIN upper s ON s.n > 1 AND s.idx = xor(t.idx >> s.lvl, 1)),
paths AS (SELECT doc_id, lang, idx, string_agg(h, '' ORDER BY lvl) AS siblings FROM steps GROUP BY ALL),
height AS (SELECT t.lang, t.lvl + (SELECT max(lvl) FROM upper) AS top FROM tops t),
folded AS (SELECT d.doc_id, d.lang, d.idx, 0 AS lvl, checked AS h FROM d
  UNION ALL SELECT f.doc_id, f.lang, f.idx, f.lvl + 1, sha256(CASE WHEN s.behind = 1 THEN f.h || s.h WHEN s.behind = 0 THEN s.h || f.h ELSE f.h END)
  FROM folded f JOIN height t ON t.lang IS NOT DISTINCT FROM f.lang AND f.lvl < t.top
  LEFT JOIN steps s ON s.lang IS NOT DISTINCT FROM f.lang AND s.idx = f.idx AND s.lvl = f.lvl)
SELECT d.doc_id, d.leaf, t.subroot, r.h AS root, sha256(coalesce(p.siblings, '')) AS proof_sha256, f.h AS folded_root, f.h = r.h AS verified
FROM d JOIN tops t ON t.lang IS NOT DISTINCT FROM d.lang JOIN (SELECT h FROM upper WHERE n = 1) r ON true
JOIN height t2 ON t2.lang IS NOT DISTINCT FROM d.lang
JOIN folded f ON f.lang IS NOT DISTINCT FROM d.lang AND f.idx = d.idx AND f.lvl = t2.top
LEFT JOIN paths p ON p.lang IS NOT DISTINCT FROM d.lang AND p.idx = d.idx"""


@query("op12_merkle_manifest", OP12_SQL)
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, and the root that tampered rows lead to."""
    docs = table(spark, sf_dir, "documents")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    tampered = merkle.digest(*(merkle.field(F.col(c) + 1 if c == "n_chars" else F.col(c)) for c in _LEAF))
    found = merkle.manifest(docs, "lang", "doc_id", _LEAF, check=F.when(hit, tampered), carry=["doc_id"])
    folded = merkle.fold(F.coalesce("checked", "leaf"), F.col("steps"))
    return found.select(
        F.col("c0").alias("doc_id"), "leaf", "subroot", "root", merkle.proof(F.col("steps")).alias("proof_sha256"),
        folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


def damaged(rows: DataFrame) -> DataFrame:
    """Rows dropped (kept as ``present`` false), emptied, without ends, repeated or given to the user, by crc32 of their key."""
    space = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    fate = F.crc32(F.concat(space["conv_id"], F.lit(":"), space["turn"]).cast("binary")) % 20
    return rows.select("conv_id", "turn", *(space[c].alias(c) for c in ("role", "text")), fate.alias("fate")).select(
        "conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("fate") != 0).alias("present"),
        F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


@query("op13_conversation_repair")
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation after damage."""
    found = conversations.repair(damaged(table(spark, sf_dir, "conversations")), present=F.col("present"))
    return found.withColumnRenamed("c0", "conv_id")
