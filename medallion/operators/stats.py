"""Counts, rollups and views behind the dashboard."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import DEFAULT_MODEL, PII_STAT_LABELS, STAGES
from ..functions.mapping import pii_count_list, pii_label


def stage_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per stage with its row count in and out (AGG-1, SET-1).

    A plain count of a Parquet table reads only file footers' row groups, no column.
    """
    parts = [df.agg(F.count("*").alias("docs_out")).select(F.lit(s).alias("stage"), "docs_out") for s, df in tables.items()]
    return reduce(DataFrame.unionByName, parts).select("stage", F.col("docs_out").alias("docs_in"), "docs_out")


def stage_view(counts: DataFrame, runs: DataFrame, search_enabled: bool = False) -> DataFrame:
    """Every known stage with counts and latest run; 0 and ``none`` where there is nothing (JOIN-12).

    The stage list is a fixed set of eight rows, counts and runs hold at most one row per stage.
    """
    meta = counts.sparkSession.createDataFrame(
        [(i, *s, s[0] == "search_serving" and not search_enabled) for i, s in enumerate(STAGES)],
        "index int, id string, name string, layer string, planned boolean",
    )
    return (
        meta.join(F.broadcast(counts.withColumnRenamed("stage", "id")), "id", "left")
        .join(F.broadcast(runs.withColumnRenamed("stage", "id")), "id", "left")
        .select(
            "id", "index", "name", "layer",
            F.coalesce("status", F.lit("none")).alias("status"),
            F.coalesce("docs_in", F.lit(0)).alias("docs_in"),
            F.coalesce("docs_out", F.lit(0)).alias("docs_out"),
            "last_run_at", "duration_ms", "planned",
        )
    )


def active_stages(stages: DataFrame) -> DataFrame:
    return stages.where(~F.col("planned"))


def masking_stats(masked: DataFrame, flag: str = "is_masked") -> DataFrame:
    """Masked, unmasked and total documents in one pass (AGG-3, AGG-10)."""
    return masked.agg(
        F.count_if(F.col(flag)).alias("masked"),
        (F.count("*") - F.count_if(F.col(flag))).alias("unmasked"),
        F.count("*").alias("total"),
    )


def stats_rows(stats: DataFrame, labels: Sequence[tuple[str, str]] = PII_STAT_LABELS) -> DataFrame:
    """The statistics record as ``{type,label,count}`` rows (PRJ-7)."""
    rows = F.array(*[
        F.struct(F.lit(kind).alias("type"), F.lit(label).alias("label"), F.col(kind).alias("count")) for kind, label in labels
    ])
    return stats.select(F.inline(rows))


def type_breakdown(masked: DataFrame, counts: str = "pii_pattern_types", flag: str = "is_masked") -> DataFrame:
    """Detections per type over flagged documents only (AGG-4).

    The flag blanks the map instead of filtering the rows: a filter on a column that comes straight from
    masking would be pushed below it and mask every text twice.
    """
    return (
        masked.select(F.explode_outer(F.when(F.col(flag), F.col(counts))).alias("type", "n"))
        .where(F.col("type").isNotNull())
        .groupBy("type")
        .agg(F.sum(F.coalesce("n", F.lit(0))).alias("count"))
        .withColumn("label", pii_label("type"))
    )


def document_rollup(staged, enriched, chunked, masked, structured, hub) -> DataFrame:
    """One row per hub with the minimum of each attribute over all its versions (AGG-2, JOIN-8).

    Chunks are reduced to one row per masked document before the document joins, so the wide columns
    (JSON, counts) are joined once per document instead of once per chunk.
    """
    per_document = (
        staged.select("enriched_id", "pclrty_class", F.to_json("es_field_info").alias("es_field_info"))
        .join(enriched.select("enriched_id", "chunk_id"), "enriched_id")
        .join(chunked.select("chunk_id", "masked_doc_id"), "chunk_id")
        .groupBy("masked_doc_id")
        .agg(F.min("pclrty_class").alias("pclrty_class"), F.min("es_field_info").alias("es_field_info"))
    )
    per_hub = (
        per_document.join(
            masked.select(
                "masked_doc_id", "structured_doc_id", "is_masked", F.to_json("pii_pattern_types").alias("pii_pattern_types")
            ),
            "masked_doc_id",
        )
        .join(structured.select("structured_doc_id", "document_hub_hash_key", "structured_content"), "structured_doc_id")
        .groupBy("document_hub_hash_key")
        .agg(
            F.min("pclrty_class").alias("pclrty_class"),
            F.min("es_field_info").alias("es_field_info"),
            F.min("is_masked").alias("is_masked"),
            F.min("pii_pattern_types").alias("pii_pattern_types"),
            F.min("structured_content").alias("structured_content"),
        )
    )
    # The hub joins last, one row to one row: a hub with very many versions is one row by then.
    named = hub.select("document_hub_hash_key", "source_primary_key")
    return per_hub.join(named, "document_hub_hash_key").select(
        F.col("document_hub_hash_key").alias("doc_id"), "source_primary_key", "pclrty_class", "es_field_info",
        "is_masked", "pii_pattern_types", "structured_content",
    )


def _first_text(*values: Column) -> Column:
    """First value that is neither NULL nor empty."""
    return F.coalesce(*[F.when(v != "", v) for v in values])


def document_view(rollup: DataFrame, priority: Column | None = None) -> DataFrame:
    """Dashboard document list from the rollup (PRJ-6, MAP-3)."""
    counts = F.from_json("pii_pattern_types", "map<string,int>")
    return rollup.select(
        _first_text(F.col("source_primary_key"), F.col("doc_id")).alias("id"),
        _first_text(
            F.get_json_object("structured_content", "$.data.title"), F.col("source_primary_key"), F.col("doc_id")
        ).alias("title"),
        (F.lit("C") if priority is None else priority).alias("priority"),
        F.col("pclrty_class").alias("security"),
        F.coalesce(
            _first_text(
                F.get_json_object("es_field_info", "$.vehicleModel"), F.get_json_object("es_field_info", "$.vehicle_model")
            ),
            F.lit(DEFAULT_MODEL),
        ).alias("vehicleModel"),
        F.coalesce("is_masked", F.lit(False)).alias("masked"),
        F.lit("gold_staged").alias("stageReached"),
        pii_count_list(counts, F.coalesce("is_masked", F.lit(False))).alias("piiCounts"),
    )


def filter_documents(view: DataFrame, priority: str = "all", masked_only: bool = False) -> DataFrame:
    """Importance and masked-only filter of the document list (FLT-4)."""
    if priority != "all":
        view = view.where(F.col("priority") == priority)
    return view.where("masked") if masked_only else view


def operation_counts(events: DataFrame, op: str = "change_operation") -> DataFrame:
    """Change events per operation (AGG-8); also as a streaming aggregation."""
    return events.groupBy(op).agg(F.count("*").alias("events"))
