"""Substring search by postings of three characters each (FLT-6)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let

GRAM = 3
FIELDS = ("title", "summary")
#: Postings of so many of a query's grams are intersected, the rarest ones.
RAREST = 4
#: Up to so many candidates are named to the scan of the rows, counted before; more are joined.
NAMED_IDS = 1_000


def grams(text: Column) -> Column:
    """Distinct runs of three characters, in time linear in the text; a NULL or shorter text has none."""
    chars = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?s)."), F.lit(0))
    return let(chars, lambda c: F.array_distinct(F.transform(
        F.slice(c, F.lit(1), F.greatest(F.size(c) - F.lit(GRAM - 1), F.lit(0))),
        lambda first, i: F.concat(first, F.get(c, i + 1), F.get(c, i + 2)))))


@dataclass
class SubstringIndex:
    """``rows`` as given, ``postings`` ``(gram, id)`` and ``counts`` ``(gram, n)``."""

    rows: DataFrame
    postings: DataFrame
    counts: DataFrame
    id: str
    fields: Sequence[str] = FIELDS


def write_substring_index(rows: DataFrame, path: str, id: str, fields: Sequence[str] = FIELDS) -> None:
    """Write rows and postings by ranges, sorted, so that a search reads the parts of files that hold its grams and ids.

    The number of files follows the data.  A frequent gram lies in several files, since ranges are of gram and id.
    """
    rows.repartitionByRange(id).sortWithinPartitions(id).write.parquet(f"{path}/rows")
    spark = rows.sparkSession
    own = spark.read.schema(rows.schema).parquet(f"{path}/rows")
    found = F.array_distinct(F.concat(*(grams(F.col(f)) for f in fields)))
    post = own.select(F.explode(found).alias("gram"), F.col(id).alias("id"))
    post.repartitionByRange("gram", "id").sortWithinPartitions("gram", "id").write.parquet(f"{path}/postings")
    written = spark.read.schema(post.schema).parquet(f"{path}/postings")
    written.groupBy("gram").agg(F.count("*").alias("n")).repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{path}/counts")


def read_substring_index(spark: SparkSession, path: str, id: str, fields: Sequence[str] = FIELDS) -> SubstringIndex:
    return SubstringIndex(*(spark.read.parquet(f"{path}/{t}") for t in ("rows", "postings", "counts")), id, fields)


def _containing(rows: DataFrame, query: str, fields: Sequence[str]) -> DataFrame:
    return rows.where(reduce(or_, [F.contains(F.col(f), F.lit(query)) for f in fields]))


def indexed_substring_search(index: SubstringIndex, query: str) -> DataFrame:
    """Rows of which a field contains the query; a blank query finds nothing.

    The rarest grams of the query give candidates, which are then tested, so the answer is that of a scan.  A
    query of fewer than three characters has no gram and is a scan.  The driver holds a count per gram of the query.
    """
    if not query.strip():
        return index.rows.where(F.lit(False))
    if len(query) < GRAM:
        return _containing(index.rows, query, index.fields)
    wanted = sorted({query[i:i + GRAM] for i in range(len(query) - GRAM + 1)})
    counts = {r["gram"]: r["n"] for r in index.counts.where(F.col("gram").isin(wanted)).collect()}
    if len(counts) < len(wanted):
        return index.rows.where(F.lit(False))
    rare = sorted(wanted, key=lambda g: (counts[g], g))[:RAREST]
    post = index.postings.where(F.col("gram").isin(rare))
    # A repeated id has repeated postings, so its different grams are counted.
    bits = reduce(lambda rest, g: F.when(F.col("gram") == rare[g], F.lit(1 << g)).otherwise(rest), range(len(rare)), F.lit(0))
    found = post.groupBy("id").agg(F.bit_or(bits).alias("bits")).where(F.col("bits") == (1 << len(rare)) - 1).select("id")
    if counts[rare[0]] <= NAMED_IDS:
        candidates = index.rows.where(F.col(index.id).isin([r["id"] for r in found.collect()]))
    else:
        candidates = index.rows.join(found.withColumnRenamed("id", index.id), index.id, "left_semi")
    return _containing(candidates, query, index.fields)
