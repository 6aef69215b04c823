"""Key-based table operations: insert-ignore, last-wins, mutations, difference, current state."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fingerprints import BUCKETS, Comparison


def _row(df: DataFrame) -> Column:
    return F.struct(*[F.col(c) for c in df.columns])


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str] | None = None) -> DataFrame:
    """One row per key: the first by ``order``, ties by the whole row.

    An aggregate instead of a window: every task keeps one row per key before the shuffle, so a key that
    holds a large share of the rows costs no more than any other.
    """
    return _pick(df, keys, order, F.min)


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str] | None = None) -> DataFrame:
    """One row per key: the last by ``order``, ties by the whole row (WIN-1)."""
    return _pick(df, keys, order, F.max)


def _pick(df, keys, order, best):
    order = list(order or [])
    rest = [c for c in df.columns if c not in keys and c not in order]
    choice = best(F.struct(*order, *rest)).alias("_row") if order or rest else F.lit(None).alias("_row")
    picked = df.groupBy(*keys).agg(choice)
    return picked.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def insert_ignore(target: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[str] | None = None):
    """Rows of the batch to append: one per key, none whose key exists (SNK-3).

    The batch is reduced to one row per key before it meets the target, so duplicates never travel far.  Rows
    with a NULL in the key name nothing and are never appended; ``null_keys`` has them.
    """
    named = batch.dropna("any", subset=list(keys))
    return first_per_key(named, keys, order).join(target.select(*keys), list(keys), "left_anti")


def null_keys(batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows to quarantine: a part of their key is NULL."""
    return batch.where(reduce(or_, [F.col(k).isNull() for k in keys]))


def apply_mutations(
    target: DataFrame,
    changes: DataFrame,
    keys: Sequence[str],
    op: str = "op",
    set_columns: Sequence[str] | None = None,
) -> DataFrame:
    """Target after inserts (if absent), updates of ``set_columns`` and deletes (SRC-11).

    ``changes`` holds one row per key with the target's columns and an ``op`` of insert/update/delete.
    One full outer join does all three.
    """
    keys = list(keys)
    data = [c for c in target.columns if c not in keys]
    set_columns = list(data if set_columns is None else set_columns)
    new = changes.select(*keys, F.col(op).alias("_op"), *[F.col(c).alias(f"_new_{c}") for c in data])
    both = target.withColumn("_old", F.lit(True)).join(new, keys, "full_outer")
    exists = F.col("_old").isNotNull()
    kept = both.where(
        (exists & ~F.col("_op").eqNullSafe("delete")) | (~exists & F.col("_op").eqNullSafe("insert"))
    )
    updated = exists & F.col("_op").eqNullSafe("update")
    return kept.select(
        *[
            F.col(c)
            if c in keys
            else F.when(~exists | (updated if c in set_columns else F.lit(False)), F.col(f"_new_{c}"))
            .otherwise(F.col(c))
            .alias(c)
            for c in target.columns
        ]
    )


def mutation_report(target: DataFrame, changes: DataFrame, keys: Sequence[str], op: str = "op") -> DataFrame:
    """Rows of each operation that took effect and that matched nothing (or already existed)."""
    hits = changes.select(*keys, F.col(op).alias("op")).join(
        target.select(*keys).withColumn("_old", F.lit(True)), list(keys), "left"
    )
    exists = F.col("_old").isNotNull()
    applied = F.when(F.col("op") == "insert", ~exists).otherwise(exists)
    return hits.groupBy("op").agg(
        F.count_if(applied).alias("applied"), F.count_if(~applied).alias("not_matched")
    )


def snapshot_diff(
    before: DataFrame, after: DataFrame, keys: Sequence[str], columns: Sequence[str], buckets: int = BUCKETS,
) -> DataFrame:
    """INSERT/UPDATE/DELETE per key between two snapshots (CDC-8); unchanged rows give nothing.

    The values themselves are compared, NULL equal to NULL, in keys too, so the smallest difference of a type counts.
    Only rows of buckets of keys whose fingerprints differ leave their task.  A repeated key counts by the rows that
    one side has more of.
    """
    keys = list(keys)
    net = Comparison(before, after, [*keys, *columns], keys, buckets).net()
    sides = net.groupBy(*keys).agg(F.max(F.col("net") > 0).alias("_b"), F.max(F.col("net") < 0).alias("_a"))
    operation = (
        F.when(F.col("_a") & F.col("_b"), F.lit("UPDATE")).when(F.col("_a"), F.lit("INSERT")).otherwise(F.lit("DELETE"))
    )
    return sides.select(*keys, operation.alias("operation"))


def current_state(changes: DataFrame, keys: Sequence[str], order: Sequence[str], op: str = "change_operation"):
    """Latest change per key without the deleted keys (CDC-10)."""
    return last_per_key(changes, keys, order).where(F.col(op) != "delete")


def upsert(target: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[str] | None = None):
    """Target rows whose key does not come in, plus the last incoming row per key (SNK-6)."""
    latest = last_per_key(incoming, keys, order)
    return target.join(latest.select(*keys), list(keys), "left_anti").unionByName(latest.select(*target.columns))


def with_defaults(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Add a constant for every column that is absent; NULL values stay NULL (PRJ-1)."""
    return df.withColumns({c: F.lit(v) for c, v in defaults.items() if c not in df.columns})


def default_when_missing(matched: Column | str, value: Column, default) -> Column:
    """Default for rows without a match; a NULL inside a matched row stays NULL (PRJ-2)."""
    matched = F.col(matched) if isinstance(matched, str) else matched
    default = default if isinstance(default, Column) else F.lit(default)
    return F.when(matched.isNull(), default).otherwise(value)


def lookup_or_first(df: DataFrame, column: str, value, order: Sequence[str]) -> DataFrame:
    """The row with the id, else the first row (FLT-7).

    The look-up is a filter the scan can use; the first row is searched only when it finds nothing.
    """
    hit = df.where(F.col(column).isNull() if value is None else F.col(column) == F.lit(value)).orderBy(*order).limit(1)
    return df.orderBy(*order).limit(1) if hit.isEmpty() else hit
