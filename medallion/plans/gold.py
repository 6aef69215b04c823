"""The whole way from report rows to classified, enriched chunks as one lazy plan.

Masking, chunking, keywords, summary and mapping are expressions of one row, so the plan has no shuffle
before its final, pre-aggregated count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import DEFAULT_PROFILE, SourceProfile
from ..functions.chunking import chunk_documents
from ..functions.enrichment import enrich_chunks
from ..functions.keys import business_key, hub_hash, surrogate_id
from ..functions.masking import mask_documents
from ..operators.stages import staged_columns


def staged_chunks(
    rows: DataFrame, source: str, key: list[str], text: str, code: str, model: str, profile: SourceProfile = DEFAULT_PROFILE
) -> DataFrame:
    """One row per chunk with hub key, masking result, enrichment and mapping."""
    masked = mask_documents(
        rows.select(
            hub_hash(F.col(source), business_key(*key)).alias("doc_key"),
            F.col(text).alias("_raw"),
            F.col(code).alias("_code"),
            F.col(model).alias("_model"),
        ),
        "_raw",
    ).drop("_raw")
    chunks = chunk_documents(masked, "doc_key", "masked_content")
    columns = staged_columns(F.col("_code"), F.col("_model"), profile)
    chunks = chunks.withColumn("_class", columns["pclrty_class"])
    enriched = enrich_chunks(
        chunks, security_class=F.col("_class"), model=F.col("_model"), importance=F.col("_code")
    )
    return enriched.select(
        surrogate_id(F.lit("staged"), "chunk_id").alias("staged_id"),
        "doc_key", "chunk_id", "chunk_sequence", "chunk_content", "pii_detection_count", "is_masked",
        "keywords", "entities", "summary", "category", "enrichment_metadata",
        *[v.alias(k) for k, v in columns.items()],
    )


def class_report(chunks: DataFrame) -> DataFrame:
    """Documents, masked documents, detections, chunks, keywords and text per security class."""
    first = F.col("chunk_sequence") == 0
    return chunks.groupBy("pclrty_class").agg(
        F.count_if(first).alias("documents"),
        F.count_if(first & F.col("is_masked")).alias("masked_documents"),
        F.sum(F.when(first, F.col("pii_detection_count")).otherwise(0)).alias("detections"),
        F.count("*").alias("chunks"),
        F.sum(F.size("keywords")).alias("keywords"),
        F.sum(F.size("entities")).alias("entities"),
        F.sum(F.length("summary")).alias("summary_chars"),
        F.sum(F.length("chunk_content")).alias("chunk_chars"),
    )
