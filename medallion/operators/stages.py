"""Incremental stages: every stage handles the rows its own output does not hold yet (INC-1)."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import DEFAULT_PROFILE, SourceProfile
from ..functions import mapping as M
from ..functions.chunking import chunk_documents
from ..functions.enrichment import enrich_chunks
from ..functions.keys import surrogate_id
from ..functions.masking import mask_documents
from ..functions.text import computed_once, let
from .silver import document_fields
from .spans import detect_spans, mask_spans


def pending(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key the stage's output does not hold; only the key column of the output is read."""
    return rows.join(done.select(key), key, "left_anti")


def to_mask(structured: DataFrame, masked: DataFrame) -> DataFrame:
    """Current documents that are not masked yet (JOIN-3)."""
    return pending(structured.where("is_latest"), masked, "structured_doc_id")


def to_chunk(masked: DataFrame, chunked: DataFrame) -> DataFrame:
    """Masked documents without chunks, superseded versions included (JOIN-4)."""
    return pending(masked, chunked, "masked_doc_id")


def to_enrich(chunked: DataFrame, masked: DataFrame, structured: DataFrame, enriched: DataFrame) -> DataFrame:
    """Chunks of current documents that are not enriched yet, with the document (JOIN-5).

    The done chunks go first, so the joins carry only what is left to do.
    """
    current = structured.where("is_latest").select("structured_doc_id", "structured_content")
    return (
        pending(chunked, enriched, "chunk_id")
        .join(masked.select("masked_doc_id", "structured_doc_id"), "masked_doc_id")
        .join(current, "structured_doc_id")
    )


def to_stage(enriched, chunked, masked, structured, staged) -> DataFrame:
    """Enriched chunks of current documents that are not staged yet, with the document (JOIN-6)."""
    current = structured.where("is_latest").select("structured_doc_id", "structured_content")
    return (
        pending(enriched, staged, "enriched_id")
        .join(chunked.select("chunk_id", "masked_doc_id"), "chunk_id")
        .join(masked.select("masked_doc_id", "structured_doc_id", "is_masked"), "masked_doc_id")
        .join(current, "structured_doc_id")
    )


def to_index(staged: DataFrame, enriched: DataFrame, chunked: DataFrame) -> DataFrame:
    """Staged rows that are not indexed yet, with chunk text and enrichment (JOIN-7, FLT-3)."""
    return (
        staged.where(F.col("indexing_status") == "staged")
        .join(enriched.select("enriched_id", "chunk_id", "keywords", "entities", "summary", "category"), "enriched_id")
        .join(chunked.select("chunk_id", "chunk_content"), "chunk_id")
    )


# Control characters as JSON writes them: five by letters, the others by number.
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}
_NUMBERED = {f"u{c:04X}": chr(c) for c in range(32) if chr(c) not in _ESCAPES.values()}
_CONTROL = r"[\x00-\x1F]"


def _unescaped(text: Column) -> Column:
    """The serialised text with its control characters as they are; other escapes stay.

    Escaped backslashes cut the text, so a backslash within a piece begins an escape; each piece is read a fixed number of times.
    """
    numbers = F.create_map(*[F.lit(x) for pair in _NUMBERED.items() for x in pair])

    def numbered(part: Column, i: Column) -> Column:
        char = numbers[F.concat(F.lit("u"), F.upper(F.substring(part, 2, 4)))]
        undone = F.coalesce(F.concat(char, F.substring(part, 6, 2**31 - 1)), F.concat(F.lit("\\"), part))
        return F.when(i == 0, part).otherwise(undone)

    def undone(piece: Column) -> Column:
        for letter, char in _ESCAPES.items():
            piece = F.replace(piece, F.lit("\\" + letter), F.lit(char))
        return F.array_join(F.transform(F.split(piece, r"\\(?=[uU]00[01])"), numbered), "")

    cut = F.array_join(F.transform(F.split(text, r"\\\\"), undone), "\\\\")
    return F.when(F.contains(text, F.lit("\\")), cut).otherwise(text)


def _escaped(text: Column) -> Column:
    """Control characters written as JSON does: the text is cut before each of them."""
    written = {char: letters for letters, char in (_ESCAPES | _NUMBERED).items()}
    names = F.array(*[F.lit("\\" + written[chr(c)]) for c in range(32)])

    def done(piece: Column) -> Column:
        control = (piece != "") & (F.ascii(piece) < 32)
        return F.when(control, F.concat(F.get(names, F.ascii(piece)), F.substring(piece, 2, 2**31 - 1))).otherwise(piece)

    return let(text, lambda t: F.when(
        t.rlike(_CONTROL), F.array_join(F.transform(F.split(t, f"(?={_CONTROL})"), done), "")).otherwise(t))


def mask_stage(
    rows: DataFrame, on: str = "leaf", detector: Callable[[], Callable[[pd.Series], list]] | None = None
) -> DataFrame:
    """Silver masking of structured documents.

    ``on="leaf"`` masks the texts as they were before serialisation: line breaks, tabs and all other control characters
    that the JSON holds as escapes are real ones while the patterns look.  ``on="json"`` masks the serialised document; there a line
    break is a backslash and a letter, the letter hides the word boundary, and what follows it is missed.

    With a ``detector`` (see ``spans.detect_spans``) its entity spans are replaced on top: the two-layer mode.
    """
    if on not in ("json", "leaf"):
        raise ValueError("on is leaf or json")
    text = F.col("structured_content")
    if on == "leaf":
        text = let(text, _unescaped)
    out = mask_documents(rows.select("structured_doc_id", text.alias("_content")), "_content")
    if detector is not None:
        out = mask_spans(out, detect_spans(out, "structured_doc_id", "masked_content", detector), "structured_doc_id")
    if on == "leaf":
        out = out.withColumn("masked_content", _escaped(F.col("masked_content")))
    return out.select(
        surrogate_id(F.lit("masked"), "structured_doc_id").alias("masked_doc_id"),
        *[c for c in out.columns if c != "_content"],
    )


def check_columns(df: DataFrame, required: dict[str, str]) -> DataFrame:
    """Fail early when a stage function breaks its contract: missing column or other type (UDF-3)."""
    have = dict(df.dtypes)
    wrong = {c: (t, have.get(c)) for c, t in required.items() if have.get(c) != t}
    if wrong:
        raise ValueError(f"stage output does not keep its contract: {wrong}")
    return df


CHUNK_CONTRACT = {"masked_doc_id": "string", "chunk_sequence": "int", "chunk_content": "string"}
ENRICH_CONTRACT = {
    "chunk_id": "string", "keywords": "array<string>", "entities": "array<string>", "summary": "string",
    "category": "string",
}


def chunk_stage(
    rows: DataFrame, chunk_fn: Callable[[DataFrame], DataFrame] | None = None, keep_all: bool = True
) -> DataFrame:
    """Gold chunking of masked documents; ``chunk_fn`` replaces the native chunker.

    ``keep_all=False`` leaves out sections after the third.
    """
    if chunk_fn is not None:
        return check_columns(chunk_fn(rows), CHUNK_CONTRACT)
    return chunk_documents(rows.select("masked_doc_id", "masked_content"), "masked_doc_id", "masked_content", keep_all=keep_all)


def enrich_stage(rows: DataFrame, enrich_fn: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Gold enrichment of pending chunks; ``enrich_fn`` replaces the native enricher."""
    if enrich_fn is not None:
        out = check_columns(enrich_fn(rows), ENRICH_CONTRACT)
    else:
        fields = document_fields("structured_content")
        rows = computed_once(rows, ["chunk_id", "chunk_content"], fields)
        out = enrich_chunks(
            rows,
            security_class=F.col("pclrty_class"),
            model=F.col("vehicle_model"),
            importance=F.col("importance_code"),
        )
    columns = ["chunk_id", "keywords", "entities", "summary", "category", "enrichment_metadata"]
    return out.select(
        surrogate_id(F.lit("enriched"), "chunk_id").alias("enriched_id"), *[c for c in columns if c in out.columns]
    )


def staged_columns(code: Column, model: Column, profile: SourceProfile = DEFAULT_PROFILE) -> dict[str, Column]:
    """Field info, roles, tags, class and status of one staged row (MAP-2)."""
    cls = M.security_class(code)
    return {
        "es_field_info": M.search_field_info(cls, profile),
        "role_ids": M.role_ids(cls, model),
        "metadata_tags": M.metadata_tags(cls, code, model, profile),
        "pclrty_class": cls,
        "indexing_status": F.lit("staged"),
    }


def stage_stage(rows: DataFrame, profile: SourceProfile = DEFAULT_PROFILE) -> DataFrame:
    """Gold field mapping of pending enriched rows."""
    fields = document_fields("structured_content", bad_code="A", bad_model="NX01")
    rows = computed_once(rows, ["enriched_id"], fields)
    return rows.select(
        surrogate_id(F.lit("staged"), "enriched_id").alias("staged_id"),
        "enriched_id",
        *[v.alias(k) for k, v in staged_columns(F.col("importance_code"), F.col("vehicle_model"), profile).items()],
    )


def mark_indexed(staged: DataFrame, indexed_ids: DataFrame, key: str = "staged_id") -> DataFrame:
    """Status ``staged`` -> ``indexed`` for the written ids; nothing ever goes back (SNK-7)."""
    hit = indexed_ids.select(key).distinct().withColumn("_hit", F.lit(True))
    return staged.join(hit, key, "left").withColumn(
        "indexing_status",
        F.when(F.col("_hit"), F.lit("indexed")).otherwise(F.col("indexing_status")),
    ).drop("_hit")


def read_stage(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A stage's table; an empty frame before its first write."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(hadoop):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def run_stage(
    spark: SparkSession, path: str, schema: T.StructType, pending_rows: Callable[[DataFrame], DataFrame],
    transform: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """One run of a stage: read its table, take what it does not hold yet, transform, append (INC-1).

    ``pending_rows`` maps the stage's table to the rows to do.  Returns the table after the run; a second run
    adds nothing.
    """
    append_stage(transform(pending_rows(read_stage(spark, path, schema))), path, schema)
    return read_stage(spark, path, schema)


def write_indexed(spark: SparkSession, indexed_ids: DataFrame, path: str, key: str = "staged_id") -> DataFrame:
    """Record ids as indexed; returns all recorded ids (SNK-7).

    The record only grows: ``mark_indexed`` with it gives every staged row's status, and nothing rewrites the
    staged rows themselves.
    """
    schema = T.StructType([T.StructField(key, indexed_ids.schema[key].dataType)])
    return run_stage(spark, path, schema, lambda done: indexed_ids.select(key).distinct().join(done, key, "left_anti"), lambda rows: rows)


def append_stage(rows: DataFrame, path: str, schema: T.StructType) -> None:
    """Append in the table's column order; the commit is atomic per job, so a failed run adds nothing."""
    rows.select(*[F.col(f.name).cast(f.dataType) for f in schema]).write.mode("append").parquet(path)
