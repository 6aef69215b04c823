"""Registry rows to structured, versionable documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import DEFAULT_CLASS, DEFAULT_IMPORTANCE, DEFAULT_MODEL, DEFAULT_PROFILE, SourceProfile
from ..functions import keys as K
from ..functions.mapping import security_class
from ..functions.text import computed_once, let
from ..schemas import PARTS, STEPS
from .tables import default_when_missing, last_per_key

JSON_OPTIONS = {"ignoreNullFields": "false"}


def probe_batches(registry: DataFrame, batches: DataFrame, order: str, path: str = "s3_path") -> DataFrame:
    """Registry rows with their batch row by (path, primary key); the last row per key wins (JOIN-2).

    ``_found`` is NULL where the batch has no such row.  All files are read in one scan; there is no loop
    over paths.
    """
    last = last_per_key(batches, [path, "source_primary_key"], [order]).withColumn("_found", F.lit(True))
    return registry.join(last, [path, "source_primary_key"], "left")


def json_array(column: Column | str, schema) -> Column:
    """Parse a JSON array; bad JSON gives an empty array, NULL stays NULL (JSN-1)."""
    c = F.col(column) if isinstance(column, str) else column
    empty = F.array().cast(schema)
    return F.when(c.isNull(), F.lit(None).cast(schema)).otherwise(F.coalesce(F.from_json(c, schema), empty))


def structure(df: DataFrame, profile: SourceProfile = DEFAULT_PROFILE) -> DataFrame:
    """Add ``structured`` (typed, nested), its JSON and the content hash (JSN-2, KEY-7).

    The input is the result of ``probe_batches``: rows without a batch row get the defaults.
    """

    def field(name: str, default) -> Column:
        return default_when_missing("_found", F.col(name), default)

    importance = field("pilot_problem_importnrate_typecd", DEFAULT_IMPORTANCE)
    document = F.struct(
        F.lit(profile.source_name).alias("source"),
        F.lit(profile.doc_type).alias("doc_type"),
        F.lit(profile.schema_version).alias("schema_version"),
        F.struct(
            F.struct(
                field("pilot_problem_no", K.first_key_part("source_primary_key")).alias("pilot_problem_no"),
                field("reform_numseq", 1).cast("int").alias("reform_numseq"),
                importance.alias("pilot_problem_importnrate_typecd"),
                security_class(importance).alias("pclrty_class"),
                field("problem_content", "").alias("problem_content"),
                field("cntmeasure_content", "").alias("cntmeasure_content"),
            ).alias("prob"),
            json_array(field("steps", "[]"), STEPS).alias("step"),
            json_array(field("parts", "[]"), PARTS).alias("part"),
            F.struct(field("pilot_vhclmodel_no", DEFAULT_MODEL).alias("pilot_vhclmodel_no")).alias("vehiclefuse"),
        ).alias("data"),
        F.struct(
            field("display_content", "").alias("display_content"),
            field("dept_name", "").alias("dept_name"),
            field("reg_empno", "").alias("manager_name"),
        ).alias("display"),
    )
    once = computed_once(df, df.columns, F.struct(document.alias("structured")))
    return once.withColumn("structured_content", F.to_json("structured", JSON_OPTIONS)).withColumn(
        "content_hash", F.md5("structured_content")
    )


_FIELDS = (
    "struct<data:struct<prob:map<string,string>,vehiclefuse:map<string,string>>,_corrupt_record:string>"
)


def document_fields(content: Column | str, bad_code: str = "", bad_model: str = "") -> Column:
    """Struct of class, importance and model read from a document's JSON in one parse (JSN-3).

    An absent field reads as its default, an explicit null as NULL.  A document that does not parse gives
    class INTERNAL and the ``bad_*`` values.
    """
    c = F.col(content) if isinstance(content, str) else content

    def fields(doc: Column) -> Column:
        bad = doc.isNull() | doc["_corrupt_record"].isNotNull()

        def field(group: str, name: str, default: str, bad_value: str) -> Column:
            values = doc["data"][group]
            present = F.coalesce(F.map_contains_key(values, name), F.lit(False))
            return F.when(bad, F.lit(bad_value)).when(present, values[name]).otherwise(F.lit(default))

        return F.struct(
            field("prob", "pclrty_class", DEFAULT_CLASS, DEFAULT_CLASS).alias("pclrty_class"),
            field("prob", "pilot_problem_importnrate_typecd", DEFAULT_IMPORTANCE, bad_code).alias("importance_code"),
            field("vehiclefuse", "pilot_vhclmodel_no", DEFAULT_MODEL, bad_model).alias("vehicle_model"),
        )

    return let(F.from_json(c, _FIELDS), fields)
