"""Incremental polling by a growing column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def poll(df: DataFrame, column: str, last=None) -> DataFrame:
    """Rows above the last high-water mark; all rows on the first poll (SRC-4).  Deletes are invisible."""
    return df if last is None else df.where(F.col(column) > F.lit(last).cast(df.schema[column].dataType))


def high_water_mark(polled: DataFrame, column: str, last=None) -> DataFrame:
    """One row: the mark to store for the next poll; the old one when nothing came."""
    top = F.max(column)
    return polled.agg((top if last is None else F.coalesce(top, F.lit(last).cast(polled.schema[column].dataType))).alias("high_water_mark"))


def stored_mark(spark: SparkSession, path: str):
    """The mark that the last committed poll left; None before the first."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return None
    return spark.read.parquet(path).agg(F.max("high_water_mark")).first()[0]


def poll_round(df: DataFrame, column: str, path: str) -> tuple[DataFrame, Callable[[], None]]:
    """Rows since the stored mark, and the commit that stores the new one (SRC-4).

    Commit after the rows are safe: a poll that failed is then simply polled again.
    """
    last = stored_mark(df.sparkSession, path)
    rows = poll(df, column, last)
    mark = high_water_mark(rows, column, last).where("high_water_mark IS NOT NULL")
    top = mark.first()  # fixed now, so that rows that come meanwhile belong to the next poll
    bounded = rows if top is None else rows.where(F.col(column) <= F.lit(top[0]))

    def commit() -> None:
        if top is not None:
            df.sparkSession.createDataFrame([top], mark.schema).write.mode("append").parquet(path)

    return bounded, commit
