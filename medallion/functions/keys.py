"""Business keys, hash keys, deterministic surrogate ids and locators.

Key parts must not be NULL (see ``operators.checks.null_violations``): ``concat`` then returns NULL
instead of silently shortening the key the way ``concat_ws`` would.  Only the poll key reads a missing
part as an empty string.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import HUB_SEPARATOR, LOCATOR_SEPARATOR, POLL_SEPARATOR


def _c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def joined(separator: str, *parts: Column | str) -> Column:
    """Parts as strings with a separator between them; NULL when any part is NULL."""
    texts = [_c(part).cast("string") for part in parts]
    return reduce(lambda left, right: F.concat(left, F.lit(separator), right), texts)


def business_key(*parts: Column | str) -> Column:
    return joined(HUB_SEPARATOR, *parts)


def hub_hash(source_name: Column | str, primary_key: Column | str) -> Column:
    """SHA-256 of ``source || primary key``; a plain string names the source itself."""
    source = F.lit(source_name) if isinstance(source_name, str) else source_name
    return F.sha2(joined(HUB_SEPARATOR, source, primary_key), 256)


def link_hash(hub: Column | str, event_id: Column | str) -> Column:
    return F.sha2(joined(HUB_SEPARATOR, hub, event_id), 256)


def satellite_hash(hub: Column | str, doc_type: Column | str) -> Column:
    doc = F.lit(doc_type) if isinstance(doc_type, str) else doc_type
    return F.sha2(joined(HUB_SEPARATOR, hub, doc), 256)


def row_hash(*parts: Column | str) -> Column:
    """MD5 of the key columns (a hash of the key, not of the row)."""
    return F.md5(joined(HUB_SEPARATOR, *parts))


def poll_key(*parts: Column | str) -> Column:
    return F.sha2(joined(POLL_SEPARATOR, *[F.coalesce(_c(p).cast("string"), F.lit("")) for p in parts]), 256)


def surrogate_id(*parts: Column | str) -> Column:
    """Reproducible id from the parent's key and a sequence number, in place of auto-increment."""
    return F.sha2(joined(HUB_SEPARATOR, *parts), 256)


def stream_locator(stream: Column | str, message_id: Column | str) -> Column:
    return F.concat(F.lit("cdc://"), joined("/", stream, message_id))


def row_locator(table: Column | str, *key_parts: Column | str) -> Column:
    name = F.lit(table) if isinstance(table, str) else table
    parts = [F.coalesce(_c(p).cast("string"), F.lit("")) for p in key_parts]
    return F.concat(F.lit("cdc://"), name, F.lit("/"), joined(LOCATOR_SEPARATOR, *parts))


def locator_bucket(path: Column | str) -> Column:
    """``bucket`` of ``s3://bucket/key``."""
    return F.substring_index(F.regexp_replace(_c(path), "s3://", ""), "/", 1)


def locator_key(path: Column | str) -> Column:
    """``key`` of ``s3://bucket/key``; empty when there is none."""
    return F.regexp_extract(F.regexp_replace(_c(path), "s3://", ""), r"^[^/]*/(?s)(.*)$", 1)


def first_key_part(primary_key: Column | str) -> Column:
    return F.substring_index(_c(primary_key), HUB_SEPARATOR, 1)
