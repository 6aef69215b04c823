"""Keywords, summary, entities and enrichment metadata of a text.

The keyword ranking is done inside the row: words are sorted, runs of equal words give count and first
place, and the best runs are kept.  No word ever crosses a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (
    DEFAULT_CLASS,
    KEYWORDS_PER_CHUNK,
    KNOWN_MODELS,
    STOP_WORDS,
    SUMMARY_FALLBACK_CHARS,
    WORD_PATTERN,
)
from .text import let, run_starts, strip


def words(text: Column, pattern: str = WORD_PATTERN, stop_words=STOP_WORDS) -> Column:
    """Words in order of appearance without the stop words."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.filter(found, lambda w: ~w.isin(*stop_words)) if stop_words else found


def most_frequent(terms: Column, top: int) -> Column:
    """The ``top`` most frequent values of an array, ties by first appearance.

    Counts are the lengths of runs in the sorted array.  Only the values above the count of the last
    place, fewer than ``top``, are looked up for their position; those that tie with it are taken in order
    of appearance by one hash intersection.
    """

    def ranked(ws: Column, s: Column, starts: Column, counts: Column, last: Column) -> Column:
        better = F.transform(
            F.filter(F.sequence(F.lit(0), F.size(starts)), lambda j: F.get(counts, j) > last),
            lambda j: F.struct(
                (-F.get(counts, j)).alias("n"),
                F.array_position(ws, F.get(s, F.get(starts, j))).alias("p"),
                F.get(s, F.get(starts, j)).alias("w"),
            ),
        )
        tied = F.transform(F.filter(starts, lambda x, j: F.get(counts, j) == last), lambda x: F.get(s, x))
        return let(
            better,
            lambda b: F.concat(
                F.transform(F.sort_array(b), lambda e: e["w"]),
                F.slice(F.array_intersect(ws, tied), F.lit(1), F.lit(top) - F.size(b)),
            ),
        )

    def counted(starts: Column, s: Column) -> Column:
        return F.transform(starts, lambda x, j: F.coalesce(F.get(starts, j + 1), F.size(s)) - x)

    def place(counts: Column) -> Column:
        return F.coalesce(F.get(F.sort_array(counts, asc=False), F.lit(top - 1)), F.lit(0))

    return let(terms, lambda ws: let(
        F.sort_array(ws), lambda s: let(
            run_starts(s), lambda starts: let(
                counted(starts, s), lambda counts: let(
                    place(counts), lambda last: ranked(ws, s, starts, counts, last))))))


def keywords(text: Column, top: int = KEYWORDS_PER_CHUNK, stop_words=STOP_WORDS) -> Column:
    """Most frequent words of a text, ties by first appearance."""
    return most_frequent(words(text, stop_words=stop_words), top)


def summary(stripped: Column) -> Column:
    """Text before the first full stop, else the first characters."""
    first = strip(F.substring_index(stripped, ".", 1))
    return F.when(first != "", first).otherwise(F.substring(stripped, 1, SUMMARY_FALLBACK_CHARS))


def entities(text: Column, known=KNOWN_MODELS) -> Column:
    """Known codes the text contains, in dictionary order."""
    return F.filter(F.array(*[F.lit(k) for k in known]), lambda k: F.contains(text, k))


def enrich_chunks(
    df: DataFrame,
    chunk_id: str = "chunk_id",
    text: str = "chunk_content",
    security_class: Column | None = None,
    model: Column | None = None,
    importance: Column | None = None,
) -> DataFrame:
    """Add keywords, entities, summary, category and the metadata struct.  A narrow operation."""
    category = F.lit(DEFAULT_CLASS) if security_class is None else security_class
    out = df.withColumn("_s", strip(F.coalesce(F.col(text), F.lit(""))))
    out = out.withColumns({
        "keywords": keywords(F.col("_s")),
        "entities": entities(F.col("_s")),
        "summary": summary(F.col("_s")),
        "category": category,
    })
    return out.withColumn(
        "enrichment_metadata",
        F.struct(
            F.col(chunk_id).cast("string").alias("chunk_id"),
            F.size("keywords").alias("keyword_count"),
            F.size("entities").alias("entity_count"),
            F.length("summary").alias("summary_length"),
            F.col("category").alias("pclrty_class"),
            (F.lit("") if model is None else model).alias("vehicle_model"),
            (F.lit("") if importance is None else importance).alias("importance_code"),
        ),
    ).drop("_s")
