"""Data-vault registration of a batch: hub, load event, link and assembly satellite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import DEFAULT_PROFILE, SourceProfile
from ..functions import keys as K
from .fingerprints import BUCKETS, Comparison
from .tables import insert_ignore, last_per_key

HUB_KEY = "document_hub_hash_key"


def hub_rows(records: DataFrame, primary_key: Column, load_ts, source=None, profile: SourceProfile = DEFAULT_PROFILE):
    """Hub rows of a batch; every row carries the batch's one load time."""
    source = F.lit(profile.source_name) if source is None else source
    return records.select(
        K.hub_hash(source, primary_key).alias(HUB_KEY),
        source.alias("source_name"),
        primary_key.alias("source_primary_key"),
        F.lit(load_ts).cast("timestamp").alias("record_load_dts"),
    )


def register_hub(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Hub rows to append: the first per key that the hub does not hold."""
    return insert_ignore(existing, incoming, [HUB_KEY], ["record_load_dts"])


def load_events(
    records: DataFrame,
    batch: Column | str,
    path: Column | str,
    load_ts,
    operation: str = "snapshot",
    profile: SourceProfile = DEFAULT_PROFILE,
) -> DataFrame:
    """One event row per batch with its row count (VLT-2); the id is reproducible."""
    batch = F.col(batch) if isinstance(batch, str) else batch
    path = F.col(path) if isinstance(path, str) else path
    counted = records.groupBy(batch.alias("batch_id"), path.alias("s3_path")).agg(
        F.count("*").alias("record_count")
    )
    return counted.select(
        K.surrogate_id(F.lit(profile.table_name), "batch_id", "s3_path").alias("bronze_rdb_event_id"),
        F.lit(profile.table_name).alias("table_name"),
        "batch_id",
        "s3_path",
        "record_count",
        F.lit(operation).alias("change_operation"),
        F.lit(load_ts).cast("timestamp").alias("event_dts"),
    )


def links(hub: DataFrame, event_id: Column | str) -> DataFrame:
    """Link rows of hub rows that carry their event id."""
    event = F.col(event_id) if isinstance(event_id, str) else event_id
    return hub.select(
        K.link_hash(HUB_KEY, event).alias("rdb_link_hash_key"), HUB_KEY, event.alias("bronze_rdb_event_id")
    )


def satellites(hub: DataFrame, load_ts, profile: SourceProfile = DEFAULT_PROFILE) -> DataFrame:
    return hub.select(
        K.satellite_hash(HUB_KEY, profile.doc_type).alias("assembly_sat_hash_key"),
        HUB_KEY,
        F.lit(profile.doc_type).alias("document_type"),
        F.lit("assembled").alias("assembly_status"),
        F.lit(0).alias("retry_count"),
        F.lit(load_ts).cast("timestamp").alias("record_load_dts"),
    )


def registry(
    hub: DataFrame, link: DataFrame, event: DataFrame, satellite: DataFrame, latest_event_only: bool = False
) -> DataFrame:
    """Hub x link x event x assembled satellite: one row per hub **and event** (JOIN-1, FLT-1).

    A load event may own a large share of all links, and so may a hub that is loaded over and over: both
    are the one side of their join, so adaptive execution splits what is hot on the other.
    ``latest_event_only`` keeps each hub's newest event instead.
    """
    assembled = satellite.where(F.col("assembly_status") == "assembled").select(HUB_KEY)
    hubs = hub.select(HUB_KEY, "source_name", "source_primary_key").join(assembled, HUB_KEY)
    events = event.select("bronze_rdb_event_id", "s3_path", "batch_id", "event_dts")
    linked = link.select(HUB_KEY, "bronze_rdb_event_id").join(events, "bronze_rdb_event_id")
    if latest_event_only:
        linked = last_per_key(linked, [HUB_KEY], ["event_dts", "bronze_rdb_event_id"])
    return linked.join(hubs, HUB_KEY).select(
        HUB_KEY, "source_name", "source_primary_key", "bronze_rdb_event_id", "s3_path", "batch_id"
    )


def parity(a: DataFrame, b: DataFrame, columns: list[str], buckets: int = BUCKETS) -> DataFrame:
    """Compare two loads of one batch (AGG-12): row counts and rows found on one side only.

    Loads that agree cross the network as sums per bucket of rows.  Rows of buckets that differ are counted per
    distinct value of ``columns`` inside the tasks first; nothing is sorted or paired.
    """
    both = Comparison(a, b, columns, buckets=buckets)
    none = F.lit(0).cast("long")
    rows = both.buckets.select("rows_a", "rows_b", none.alias("only_a"), none.alias("only_b"))
    net = both.net().select(
        none.alias("rows_a"), none.alias("rows_b"),
        F.greatest("net", F.lit(0)).alias("only_a"), F.greatest(-F.col("net"), F.lit(0)).alias("only_b"))
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in rows.columns]
    return rows.unionAll(net).agg(*sums).withColumn("same_columns", F.lit(sorted(a.columns) == sorted(b.columns)))
