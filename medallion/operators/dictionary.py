"""Entities of a large dictionary: one automaton over its codes, one pass over each text (JOIN-9)."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import computed_once
from ..session import WorkTables

#: Characters of codes in one automaton, which takes some hundred bytes for each of them in every Python worker.
BLOCK_CHARS = 1_000_000


def automaton(codes: list[str]) -> ahocorasick.Automaton:
    """Finds every code of the list, overlapping ones too, in time linear in the text and the finds."""
    built = ahocorasick.Automaton()
    for code in codes:
        built.add_word(code, code)
    built.make_automaton()
    return built


def contained(built: ahocorasick.Automaton, text: str | None) -> list[str]:
    """The codes the text contains, each once, ascending."""
    return sorted({code for _, code in built.iter(text)}) if text and len(built) else []


def _blocks(codes: DataFrame, block_chars: int) -> tuple[DataFrame, int]:
    """Codes with ``block``, and the number of blocks, none of which has more characters unless one code has.

    The sizes are counted; while one is too large, blocks are halved by one more bit of the hash of their codes.
    """
    blocks = 1
    while True:
        cut = codes.withColumn("block", F.pmod(F.xxhash64("code"), F.lit(blocks)))
        sizes = cut.groupBy("block").agg(F.sum(F.length("code")).alias("chars"), F.count("*").alias("n"))
        if sizes.where((F.col("chars") > block_chars) & (F.col("n") > 1)).isEmpty():
            return cut, blocks
        blocks *= 2


def _automaton_once(codes: Broadcast, built: dict = {}) -> ahocorasick.Automaton:  # noqa: B006 - kept by the worker
    """The automaton of a block, made once in each Python worker; the worker keeps the last one only."""
    key = hash(tuple(codes.value))
    if key not in built:
        built.clear()
        built[key] = automaton(codes.value)
    return built[key]


def dictionary_entities(
    df: DataFrame, text: str, codes: DataFrame, code: str = "code", into: str = "entities", block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """``df`` with ``into``: the codes of a dictionary table that ``text`` contains, each once, ascending.

    NULL and empty codes are none, repeated ones count once; a NULL or empty text, or an empty dictionary, gives an
    empty array.  The dictionary is not in the plan: its codes are broadcast as a block of counted size.  With one
    block nothing is shuffled or written.  A larger dictionary is matched block by block: the rows are written once
    with a number, each block's finds are written before the next block is broadcast, and only finds are shuffled.
    """
    if into.lower() in (c.lower() for c in df.columns):
        raise ValueError(f"{into} is a column already")
    spark = df.sparkSession
    work = WorkTables(spark)
    own = codes.select(F.col(f"`{code}`").cast("string").alias("code")).where(F.col("code") != "").distinct()
    cut, blocks = _blocks(work.write(own, "dictionary"), block_chars)
    kind = "array<string>"

    def block(number: int) -> Broadcast:
        return spark.sparkContext.broadcast(sorted(r["code"] for r in cut.where(F.col("block") == number).select("code").collect()))

    if blocks == 1:
        whole = block(0)
        work.drop()

        @F.pandas_udf(kind)
        def found(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            built = _automaton_once(whole)
            for part in texts:
                yield part.map(lambda t: contained(built, t)).astype(object)

        entities = F.struct(found(F.col(f"`{text}`").cast("string")).alias(into))
        return computed_once(df, [F.col(f"`{c}`") for c in df.columns], entities)

    names = {c.lower() for c in df.columns}
    row = next(n for n in (f"row_{i}" for i in range(len(names) + 1)) if n not in names)
    numbered = work.write(df.withColumn(row, F.monotonically_increasing_id()), "texts")
    finds = None
    for number in range(blocks):
        part = block(number)

        def match(batches: Iterator[pa.RecordBatch], part: Broadcast = part) -> Iterator[pa.RecordBatch]:
            built = _automaton_once(part)
            for batch in batches:
                hits = [(i, c) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if (c := contained(built, t))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i for i, _ in hits], pa.int64()), pa.array([c for _, c in hits], pa.list_(pa.string()))], names=["row", "found"])

        narrow = numbered.select(F.col(row).alias("row"), F.col(f"`{text}`").cast("string").alias("text"))
        one = work.write(narrow.mapInArrow(match, f"row long, found {kind}"), "finds")
        part.destroy()
        finds = one if finds is None else finds.unionByName(one)
    per_row = finds.groupBy(F.col("row").alias(row)).agg(F.sort_array(F.flatten(F.collect_list("found"))).alias(into))
    return numbered.join(per_row, row, "left").select(
        *(F.col(f"`{c}`") for c in df.columns), F.coalesce(F.col(into), F.array().cast(kind)).alias(into))
