"""Slowly changing dimension of type 2 (SCD-1..3)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skew import Ranges, neighbour, ranges


def versions(df: DataFrame, key: str, valid_from: str, seq: str) -> DataFrame:
    """Close every version with the start of the next one of the same key.

    Every row is a version, also with an unchanged hash.  Rows with equal ``valid_from`` follow each
    other by ``seq`` and give zero-length intervals.
    """
    closed = neighbour(df, [key], [valid_from, seq], valid_from, "valid_to", step=1)
    return closed.withColumn("is_latest", F.col("valid_to").isNull())


def drop_unchanged(df: DataFrame, key: str, content_hash: str, order: Sequence[str], known: Ranges | None = None) -> DataFrame:
    """Leave out rows whose hash equals the previous row's of the same key (SCD-2)."""
    before = neighbour(df, [key], list(order), content_hash, "_before", step=-1, known=known)
    return before.where(~F.col(content_hash).eqNullSafe(F.col("_before"))).drop("_before")


def scd2_apply(
    current: DataFrame,
    incoming: DataFrame,
    key: str,
    valid_from: str = "valid_from",
    seq: str = "seq",
    content_hash: str = "content_hash",
    changed_only: bool = False,
) -> DataFrame:
    """The version table after one batch.

    Closed versions and current versions of untouched keys pass through without a shuffle of their
    own; only current versions of incoming keys meet the batch.  ``current`` has the columns of
    ``incoming`` plus ``valid_to`` and ``is_latest``.
    """
    columns = [*incoming.columns, "valid_to", "is_latest"]
    open_rows = current.where("is_latest")
    touched = incoming.select(key).distinct()
    base = open_rows.join(touched, key, "left_semi").select(*incoming.columns)
    batch = base.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    order = [valid_from, "_new", seq]
    known = ranges(batch, [key], order)
    if changed_only:
        batch = drop_unchanged(batch, key, content_hash, order, known)
    closed = neighbour(batch, [key], order, valid_from, "valid_to", step=1, known=known)
    closed = closed.withColumn("is_latest", F.col("valid_to").isNull())
    return (
        current.where(~F.col("is_latest")).select(*columns)
        .unionByName(open_rows.join(touched, key, "left_anti").select(*columns))
        .unionByName(closed.select(*columns))
    )


def latest(df: DataFrame) -> DataFrame:
    """Current versions only."""
    return df.where("is_latest")
