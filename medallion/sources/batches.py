"""Bronze batch files: write, collect, read and probe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_batch(df: DataFrame, root: str, batch_id: str | None = None) -> None:
    """Write a batch to ``root/batch_id=...``; the same batch id overwrites, others stay (SNK-1).

    Without ``batch_id`` the rows carry their own ``batch_id`` column.  ``rebalance`` gives files of even
    size also when one batch holds most rows.
    """
    rows = df if batch_id is None else df.withColumn("batch_id", F.lit(batch_id))
    _overwrite_partitions(rows, ["batch_id"], root)


def write_collected(df: DataFrame, root: str, row_hash: Column, load_date: Column) -> None:
    """Collector write: row hash added, one folder per source and day (SNK-2)."""
    rows = df.withColumn("row_hash", row_hash).withColumn("load_date", load_date)
    _overwrite_partitions(rows, ["source_name", "load_date"], root)


def _overwrite_partitions(rows: DataFrame, columns: list[str], root: str) -> None:
    (
        rows.hint("rebalance", *columns)
        .write.partitionBy(*columns)
        .mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .parquet(root)
    )


def read_batch(spark: SparkSession, root: str, schema: T.StructType, batch_id: str | None = None) -> DataFrame:
    """Batches below the root; the batch id prunes folders (SRC-1)."""
    full = T.StructType([f for f in schema if f.name != "batch_id"] + [T.StructField("batch_id", T.StringType())])
    df = spark.read.schema(full).parquet(root)
    return df if batch_id is None else df.where(F.col("batch_id") == batch_id)


def with_path(df: DataFrame, column: str = "s3_path", folder: bool = True) -> DataFrame:
    """Add the file each row came from, or its folder, so that many files are read in one scan (SRC-2)."""
    path = F.col("_metadata.file_path")
    return df.select("*", (F.regexp_replace(path, "/[^/]*$", "") if folder else path).alias(column))


def read_jdbc(
    spark: SparkSession, url: str, table: str, partition_column: str, lower, upper, partitions: int, **options
) -> DataFrame:
    """Relational table in parallel ranges of one column; projections and filters go to the database (SRC-3)."""
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=table, partitionColumn=partition_column, lowerBound=str(lower))
        .options(upperBound=str(upper), numPartitions=str(partitions), **options)
        .load()
    )
