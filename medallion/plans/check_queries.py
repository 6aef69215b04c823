"""Constraint and reconciliation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.chunking import chunk_documents
from ..operators import checks as CK
from .registry import query, table


@query(
    "pk_duplicates",
    "SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY ALL HAVING count(*) > 1",
)
def pk_duplicates(spark, d):
    """CHK-1."""
    return CK.duplicate_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "fk_orphans",
    """SELECT 'orders' AS child, o_custkey AS key, count(*) AS rows FROM orders
  WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING') GROUP BY ALL
UNION ALL SELECT 'documents', doc_id, count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY ALL
UNION ALL SELECT 'lineitem', l_partkey, count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 25) GROUP BY ALL""",
)
def fk_orphans(spark, d):
    """CHK-2."""
    pairs = (
        ("orders", "o_custkey", table(spark, d, "customer").where("c_mktsegment <> 'BUILDING'"), "c_custkey"),
        ("documents", "doc_id", table(spark, d, "labels"), "doc_id"),
        ("lineitem", "l_partkey", table(spark, d, "part").where("p_size > 25"), "p_partkey"),
    )
    parts = [
        CK.orphans(table(spark, d, child), key, parent, parent_key).select(
            F.lit(child).alias("child"), F.col(key).alias("key"), "rows"
        )
        for child, key, parent, parent_key in pairs
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "contract_nulls",
    """WITH j AS (SELECT d.doc_id, text, quality, CASE WHEN lang = 'de' THEN NULL ELSE lang END AS lang FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
SELECT 'doc_id' AS "column", count(*) FILTER (doc_id IS NULL) AS nulls FROM j
UNION ALL SELECT 'text', count(*) FILTER (text IS NULL) FROM j UNION ALL SELECT 'lang', count(*) FILTER (lang IS NULL) FROM j
UNION ALL SELECT 'quality', count(*) FILTER (quality IS NULL) FROM j UNION ALL SELECT 'absent', count(*) FROM j""",
)
def contract_nulls(spark, d):
    """CHK-3."""
    docs = table(spark, d, "documents").withColumn("lang", F.when(F.col("lang") != "de", F.col("lang")))
    joined = docs.join(table(spark, d, "labels"), "doc_id", "left")
    return CK.null_violations(joined, ["doc_id", "text", "lang", "quality", "absent"])


@query(
    "reconcile_counts",
    """WITH c AS (SELECT (SELECT count(*) FROM documents) AS d, (SELECT count(*) FROM labels) AS l)
SELECT 'chunks are three per document' AS rule, d * 3 AS actual, d * 3 AS expected, true AS ok FROM c
UNION ALL SELECT 'labels cover the documents', l, d, l = d FROM c""",
)
def reconcile_counts(spark, d):
    """CHK-4."""
    docs = table(spark, d, "documents")
    chunks = chunk_documents(docs.select("doc_id", "text"), "doc_id", "text")
    tables = {"documents": docs, "chunks": chunks, "labels": table(spark, d, "labels")}
    return CK.reconcile(
        tables,
        [("chunks are three per document", "chunks", "documents", 3), ("labels cover the documents", "labels", "documents", 1)],
    )
