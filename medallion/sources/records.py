"""JSON records: files, columns, and the hash bridge."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import hub_hash


def read_json_records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON files that hold one object or a list; bad JSON stops the job, empty files give no rows (SRC-8)."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def parse_json_records(df: DataFrame, column: str, schema: str) -> DataFrame:
    """The same for JSON texts in a column; blank texts give no rows."""
    parsed = F.from_json(F.col(column), f"array<struct<{schema}>>", {"mode": "FAILFAST"})
    return df.where(F.trim(column) != "").select(*[c for c in df.columns if c != column], F.inline(parsed))


def hash_records(df: DataFrame, column: str) -> DataFrame:
    """Add the row hash of JSON records and the record with the hash in it (KEY-10).

    ``error`` is NULL for good records; the others have neither hash nor record.  A record is the whole text:
    anything after its end is an error.  A ``row_hash`` it brings along is replaced.
    """
    names = "struct<source_name:string,primary_key:string,row_hash:string>"
    # As the only item of a list, so that text after the object can't be overlooked.
    parsed = df.withColumn("_r", F.from_json(column, names))
    parsed = parsed.withColumn("_whole", F.try_parse_json(F.concat(F.lit("["), F.col(column), F.lit("]"))))
    one = F.size(F.col("_whole").cast("array<variant>")) == 1
    is_object = F.trim(column).startswith("{") & F.col("_r").isNotNull() & one
    hashed = hub_hash(
        F.coalesce("_r.source_name", F.lit("unknown")), F.coalesce("_r.primary_key", F.lit(""))
    )
    body = F.regexp_replace(F.rtrim(F.col(column)), r"\s*\}$", "")
    comma = F.when(F.trim(body) == "{", F.lit("")).otherwise(F.lit(", "))
    added = F.concat(body, comma, F.lit('"row_hash": "'), F.col("row_hash"), F.lit('"}'))
    fields = F.col("_whole").cast("array<map<string, variant>>")[0]
    others = F.map_filter(fields, lambda k, _: k != "row_hash")
    replaced = F.to_json(F.map_concat(others, F.create_map(F.lit("row_hash"), F.parse_json(F.concat(F.lit('"'), F.col("row_hash"), F.lit('"'))))))
    has_hash = F.array_contains(F.map_keys(fields), "row_hash")
    good = F.coalesce(is_object, F.lit(False))
    return (
        parsed.withColumn("row_hash", F.when(good, hashed))
        .withColumn(
            "record", F.when(good & has_hash, replaced).when(good, added)
        )
        .withColumn("error", F.when(~good, F.lit("invalid JSON input")))
        .drop("_r", "_whole")
    )
