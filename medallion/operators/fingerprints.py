"""Comparing two tables by order-free sums of row hashes; only parts that differ are compared row by row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

#: Buckets of a comparison: its sums are one row per bucket and task, and one changed row brings its bucket's rows.
BUCKETS = 4096
# A hash is summed in pieces of so many bits, so that no count of rows below 2^41 overflows a sum.
_PIECE = 21


def hash_inputs(value: Column, kind: DataType) -> list[Column]:
    """Inputs of a row hash that tell apart all the values of a type: the hash itself passes over NULL."""
    if isinstance(kind, StructType):
        return [value.isNull(), *(x for f in kind.fields for x in hash_inputs(value.getField(f.name), f.dataType))]
    if isinstance(kind, ArrayType):
        return [value.isNull(), F.size(value), F.transform(value, lambda x: F.xxhash64(*hash_inputs(x, kind.elementType)))]
    if isinstance(kind, MapType):
        entries = F.transform(F.map_entries(value), lambda e: F.struct(
            F.xxhash64(*hash_inputs(e["key"], kind.keyType)).alias("k"), F.xxhash64(*hash_inputs(e["value"], kind.valueType)).alias("v")))
        return [value.isNull(), F.size(value), F.sort_array(entries)]
    return [value.isNull(), value]


def _row_hash(df: DataFrame, columns: Sequence[str], seed: int) -> Column:
    return F.xxhash64(F.lit(seed), *(x for c in columns for x in hash_inputs(F.col(f"`{c}`"), df.schema[c].dataType)))


class Comparison:
    """Two tables as multisets of rows of ``columns``, in buckets by the hash of ``keys`` (by default the whole row).

    Columns of different types are compared as a union holds them.  NULL equals NULL.  Each bucket has the sum of two
    64-bit hashes of its rows, those of the second table taken away.  Two buckets that differ are taken for equal with a
    probability of about 2^-120.  Both tables are read twice, so costly ones should be written first.
    """

    def __init__(self, a: DataFrame, b: DataFrame, columns: Sequence[str], keys: Sequence[str] | None = None, buckets: int = BUCKETS):
        self.columns = list(dict.fromkeys(columns))
        named = [F.col(f"`{c}`") for c in self.columns]
        rows = a.select(*named, F.lit(1).alias("_sign")).unionAll(b.select(*named, F.lit(-1).alias("_sign")))
        self.rows = rows.withColumn("_bucket", F.pmod(_row_hash(rows, keys or self.columns, 0), F.lit(buckets)))
        hashed = self.rows.select("_bucket", "_sign", *(_row_hash(rows, self.columns, s).alias(f"_h{s}") for s in (1, 2)))
        pieces = [
            F.sum(F.col("_sign") * F.shiftrightunsigned(f"_h{s}", shift).bitwiseAND(F.lit((1 << _PIECE) - 1))).alias(f"_s{s}_{shift}")
            for s in (1, 2) for shift in range(0, 3 * _PIECE, _PIECE)
        ]
        #: One row per bucket: rows of either table and whether they differ.
        sums = hashed.groupBy("_bucket").agg(
            F.count_if(F.col("_sign") > 0).alias("rows_a"), F.count_if(F.col("_sign") < 0).alias("rows_b"), *pieces)
        same = F.col("rows_a") == F.col("rows_b")
        for s in (1, 2):
            for shift in range(0, 3 * _PIECE, _PIECE):
                same = same & (F.col(f"_s{s}_{shift}") == 0)
        self.buckets = sums.select("_bucket", "rows_a", "rows_b", (~same).alias("differs"))

    def suspects(self) -> DataFrame:
        """Rows of the buckets that differ; the others stop in the task that read them."""
        changed = self.buckets.where("differs").select("_bucket")
        return self.rows.join(F.broadcast(changed), "_bucket", "left_semi").drop("_bucket")

    def net(self) -> DataFrame:
        """``columns`` and ``net``: how many rows more the first table has (less than 0: the second), where not equal."""
        rows = self.suspects().groupBy(*(F.col(f"`{c}`") for c in self.columns)).agg(F.sum("_sign").alias("net"))
        return rows.where(F.col("net") != 0)
