"""Security class, roles, tags and search-field info of a document."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import DEFAULT_CLASS, DEFAULT_PROFILE, IMPORTANCE_TO_CLASS, PII_LABELS, SourceProfile
from .text import mapped


def _c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def security_class(code: Column | str, mapping=None, default: str = DEFAULT_CLASS) -> Column:
    return mapped(code, mapping or IMPORTANCE_TO_CLASS, default)


def pii_label(kind: Column | str) -> Column:
    """Display label of a personal-data type; an unknown type is its own label."""
    return mapped(kind, PII_LABELS, _c(kind))


def role_ids(cls: Column | str, model: Column | str) -> Column:
    return F.array(F.concat(F.lit("ROLE_"), _c(cls)), F.concat(F.lit("ROLE_"), _c(model)))


def search_field_info(cls: Column | str, profile: SourceProfile = DEFAULT_PROFILE) -> Column:
    return F.struct(F.lit(profile.search_index).alias("target_index"), _c(cls).alias("routing"))


def metadata_tags(
    cls: Column | str, code: Column | str, model: Column | str, profile: SourceProfile = DEFAULT_PROFILE
) -> Column:
    return F.create_map(
        F.lit("pclrty_class"), _c(cls),
        F.lit("importance_code"), _c(code),
        F.lit("vehicle_model"), _c(model),
        F.lit("source"), F.lit(profile.source_name),
        F.lit("doc_type"), F.lit(profile.doc_type),
    )


def pii_count_list(counts: Column | str, masked: Column | str) -> Column:
    """``[{type,label,count}]`` of a masked document, an empty list otherwise; NULL counts read as 0."""
    rows = F.transform(
        F.map_entries(_c(counts)),
        lambda e: F.struct(
            e["key"].alias("type"), pii_label(e["key"]).alias("label"), F.coalesce(e["value"], F.lit(0)).alias("count")
        ),
    )
    empty = F.from_json(F.lit("[]"), "array<struct<type:string,label:string,count:int>>")
    return F.when(_c(masked) & _c(counts).isNotNull(), rows).otherwise(empty)
