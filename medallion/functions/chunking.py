"""Section chunking of one text into a fixed number of chunks, as an array expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import CHUNK_METHOD, CHUNKS_PER_DOCUMENT, EMPTY_CHUNK, SECTION_MARKERS
from .keys import surrogate_id
from .text import let, strip


def section_starts(text: Column, markers=SECTION_MARKERS) -> Column:
    """1-based starts of the sections: first place of each marker, plus 1 for text before the first one."""
    found = F.sort_array(F.filter(F.array(*[F.instr(text, m) for m in markers]), lambda p: p > 0))
    return let(
        found,
        lambda f: F.when(F.get(f, F.lit(0)) > 1, F.concat(F.array(F.lit(1)), f)).otherwise(f),
    )


def sections(text: Column, starts: Column) -> Column:
    """Texts from each start to the next one, the last to the end."""
    return F.transform(
        starts,
        lambda start, i: F.substring(text, start, F.coalesce(F.get(starts, i + 1), F.lit(2**31 - 1)) - start),
    )


def equal_parts(text: Column, n: int = CHUNKS_PER_DOCUMENT) -> Column:
    """``n`` parts of equal length; the last one takes the rest."""

    def cut(size: Column) -> Column:
        parts = [F.substring(text, F.lit(i) * size + F.lit(1), size) for i in range(n - 1)]
        return F.array(*parts, F.substring(text, F.lit(n - 1) * size + F.lit(1), F.lit(2**31 - 1)))

    return let(F.greatest(F.lit(1), F.floor(F.length(text) / F.lit(n)).cast("int")), cut)


def chunk_array(stripped: Column, starts: Column, n: int = CHUNKS_PER_DOCUMENT, keep_all: bool = True) -> Column:
    """Chunk texts of a stripped text: its sections if it has ``n`` or more, else ``n`` equal parts.

    ``keep_all=False`` leaves out the sections after the ``n``-th.
    """
    cut = sections(stripped, starts)
    by_section = cut if keep_all else F.slice(cut, 1, n)
    chosen = F.when(F.size(starts) >= n, by_section).otherwise(equal_parts(stripped, n))
    before, after = EMPTY_CHUNK.split("{}")
    return F.transform(
        F.transform(chosen, lambda c: strip(c)),
        lambda c, i: F.when(
            c == "", F.concat(F.lit(before), (i + 1).cast("string"), F.lit(after))
        ).otherwise(c),
    )


def chunk_documents(
    df: DataFrame, doc_id: str, text: str, n: int = CHUNKS_PER_DOCUMENT, keep_all: bool = True
) -> DataFrame:
    """One row per chunk: id, parent id, 0-based sequence, text and metadata.  A narrow operation."""
    staged = df.withColumn("_text", strip(F.coalesce(F.col(text), F.lit(""))))
    chunks = let(section_starts(F.col("_text")), lambda starts: chunk_array(F.col("_text"), starts, n, keep_all))
    staged = staged.withColumn("_chunks", chunks)
    rest = [c for c in df.columns if c not in (doc_id, text)]
    # The array is never empty.  The outer form keeps the optimizer from adding a filter on its size,
    # which would compute all chunks a second time below.
    exploded = staged.select(
        F.col(doc_id), *rest, F.posexplode_outer("_chunks").alias("chunk_sequence", "chunk_content")
    )
    return exploded.select(
        surrogate_id(doc_id, "chunk_sequence").alias("chunk_id"),
        doc_id,
        *rest,
        "chunk_sequence",
        "chunk_content",
        F.struct(
            F.col(doc_id).cast("string").alias("doc_id"),
            F.col("chunk_sequence").alias("sequence"),
            F.length("chunk_content").alias("char_count"),
            F.lit(CHUNK_METHOD).alias("chunk_method"),
        ).alias("chunk_metadata"),
    )
