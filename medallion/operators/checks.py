"""Constraint and reconciliation checks.  Each returns counts, never the driver-side list of offenders."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys with more than one row (CHK-1)."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str | None = None) -> DataFrame:
    """Child keys without a parent and their row counts (CHK-2).

    The child is counted per key first: a key with very many rows meets the parent as one row.
    """
    per_key = child.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("rows"))
    parents = parent.select(F.col(parent_key or key).alias(key))
    return per_key.join(parents, key, "left_anti")


def null_violations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NULLs per required column in one pass; a missing column counts every row (CHK-3)."""
    counts = [
        (F.count_if(F.col(c).isNull()) if c in df.columns else F.count("*")).alias(c) for c in columns
    ]
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in columns])
    return df.agg(*counts).select(F.inline(rows))


def reconcile(tables: Mapping[str, DataFrame], expected: Sequence[tuple[str, str, str, int]]) -> DataFrame:
    """Row-count rules ``(rule, left, right, factor)``: rows(left) = factor x rows(right) (CHK-4)."""
    used = {t for _, left, right, _ in expected for t in (left, right)}
    counted = reduce(
        DataFrame.unionByName,
        [tables[t].agg(F.count("*").alias("n")).select(F.lit(t).alias("t"), "n") for t in sorted(used)],
    )
    pivoted = counted.agg(*[F.max(F.when(F.col("t") == t, F.col("n"))).alias(t) for t in sorted(used)])
    rules = F.array(*[
        F.struct(
            F.lit(rule).alias("rule"),
            F.col(left).alias("actual"),
            (F.col(right) * F.lit(factor)).cast("long").alias("expected"),
        )
        for rule, left, right, factor in expected
    ])
    return pivoted.select(F.inline(rules)).withColumn("ok", F.col("actual") == F.col("expected"))
