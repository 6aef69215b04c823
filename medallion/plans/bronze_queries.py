"""Queries over keys, registration, batches and table operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions.text import strip_prefix
from ..operators import bronze as B
from ..operators import tables as T
from ..session import work_path
from ..sources import batches
from .inputs import LOAD_TS, REPORTS_SQL, reports
from .registry import query, table

_PK = "pilot_problem_no || '||' || CAST(reform_numseq AS VARCHAR)"
_HUB = f"sha256(source || '||' || {_PK})"


def _key():
    return K.business_key("pilot_problem_no", "reform_numseq")


@query(
    "business_keys",
    """SELECT l_orderkey || '||' || l_linenumber AS business_key,
  md5(l_orderkey || '||' || l_linenumber) AS row_hash,
  sha256(l_orderkey || '|' || l_linenumber) AS poll_key,
  'cdc://report_history/' || l_orderkey || ':' || l_linenumber AS locator, count(*) AS row_count
FROM lineitem GROUP BY ALL""",
)
def business_keys(spark, d):
    """KEY-1, 5, 6, 9."""
    parts = ("l_orderkey", "l_linenumber")
    # The keys are counted before the hashes, so every hash is made once per key.
    counted = table(spark, d, "lineitem").groupBy(*parts).agg(F.count("*").alias("row_count"))
    return counted.select(
        K.business_key(*parts).alias("business_key"),
        K.row_hash(*parts).alias("row_hash"),
        K.poll_key(*parts).alias("poll_key"),
        K.row_locator("report_history", *parts).alias("locator"),
        "row_count",
    )


@query(
    "hub_register",
    f"""WITH {REPORTS_SQL}
SELECT {_HUB} AS document_hub_hash_key, source AS source_name, {_PK} AS source_primary_key
FROM reports WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
)
def hub_register(spark, d):
    """KEY-1, KEY-2, SNK-3: a batch that repeats its rows against a hub that holds the labelled documents."""
    rows = reports(spark, d)
    known = rows.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")

    def hub(df):
        return B.hub_rows(df, _key(), LOAD_TS, F.col("source"))

    new = B.register_hub(hub(known), hub(rows).unionByName(hub(rows)))
    return new.select("document_hub_hash_key", "source_name", "source_primary_key")


@query(
    "vault_link_sat",
    f"""WITH {REPORTS_SQL}, h AS (SELECT {_HUB} AS hub, lang AS event_id FROM reports)
SELECT hub AS document_hub_hash_key, sha256(hub || '||' || event_id) AS rdb_link_hash_key,
  sha256(hub || '||report') AS assembly_sat_hash_key, 'assembled' AS assembly_status FROM h""",
)
def vault_link_sat(spark, d):
    """KEY-3, KEY-4, VLT-1."""
    hub = reports(spark, d).select(K.hub_hash(F.col("source"), _key()).alias(B.HUB_KEY), "lang")
    link = K.link_hash(B.HUB_KEY, "lang").alias("rdb_link_hash_key")
    return hub.select(
        B.HUB_KEY, link, K.satellite_hash(B.HUB_KEY, "report").alias("assembly_sat_hash_key"),
        F.lit("assembled").alias("assembly_status"),
    )


_REST = "l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus"


@query(
    "insert_ignore",
    f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, {_REST}) AS rn
  FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice FROM r
WHERE rn = 1 AND (l_orderkey, l_linenumber) NOT IN
  (SELECT (l_orderkey, l_linenumber) FROM lineitem WHERE l_returnflag = 'R')""",
)
def insert_ignore(spark, d):
    """SNK-3 on a key that repeats: the target holds the keys of returned lines."""
    lines = table(spark, d, "lineitem")
    target = lines.where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber")
    new = T.insert_ignore(target, lines, ["l_orderkey", "l_linenumber"], ["l_shipdate"])
    return new.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")


_CHANGES_SQL = """changes AS (
  SELECT o_orderkey, o_custkey, o_totalprice * 2 AS o_totalprice, o_orderstatus,
    CASE o_orderstatus WHEN 'F' THEN 'update' WHEN 'P' THEN 'delete' ELSE 'insert' END AS op FROM orders
  UNION ALL
  SELECT -1 - c_custkey, c_custkey, c_acctbal, 'N',
    CASE c_mktsegment WHEN 'BUILDING' THEN 'update' WHEN 'MACHINERY' THEN 'delete' ELSE 'insert' END FROM customer)"""


def _mutation_input(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    segment = F.col("c_mktsegment")
    of_orders = orders.withColumn("o_totalprice", F.col("o_totalprice") * 2).withColumn(
        "op",
        F.when(F.col("o_orderstatus") == "F", "update").when(F.col("o_orderstatus") == "P", "delete").otherwise("insert"),
    )
    of_customers = table(spark, d, "customer").select(
        (-1 - F.col("c_custkey")).alias("o_orderkey"),
        F.col("c_custkey").alias("o_custkey"),
        F.col("c_acctbal").alias("o_totalprice"),
        F.lit("N").alias("o_orderstatus"),
        F.when(segment == "BUILDING", "update").when(segment == "MACHINERY", "delete").otherwise("insert").alias("op"),
    )
    return orders, of_orders.unionByName(of_customers)


@query(
    "apply_mutations",
    f"""WITH {_CHANGES_SQL}
SELECT coalesce(o.o_orderkey, c.o_orderkey) AS o_orderkey, coalesce(o.o_custkey, c.o_custkey) AS o_custkey,
  CASE WHEN o.o_orderkey IS NULL OR c.op = 'update' THEN c.o_totalprice ELSE o.o_totalprice END AS o_totalprice,
  coalesce(o.o_orderstatus, c.o_orderstatus) AS o_orderstatus
FROM orders o FULL JOIN changes c ON o.o_orderkey = c.o_orderkey
WHERE CASE WHEN o.o_orderkey IS NULL THEN c.op = 'insert' ELSE c.op IS DISTINCT FROM 'delete' END""",
)
def apply_mutations(spark, d):
    """SRC-11."""
    target, changes = _mutation_input(spark, d)
    return T.apply_mutations(target, changes, ["o_orderkey"], set_columns=["o_totalprice"])


@query(
    "mutation_report",
    f"""WITH {_CHANGES_SQL}, hit AS (
  SELECT c.op, CASE WHEN c.op = 'insert' THEN o.o_orderkey IS NULL ELSE o.o_orderkey IS NOT NULL END AS ok
  FROM changes c LEFT JOIN orders o ON o.o_orderkey = c.o_orderkey)
SELECT op, count(*) FILTER (ok) AS applied, count(*) FILTER (NOT ok) AS not_matched FROM hit GROUP BY op""",
)
def mutation_report(spark, d):
    """SRC-11: what took effect."""
    target, changes = _mutation_input(spark, d)
    return T.mutation_report(target, changes, ["o_orderkey"])


@query(
    "last_wins",
    f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
  ORDER BY l_shipdate DESC, {", ".join(c + " DESC" for c in _REST.split(", "))}) AS rn FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_returnflag FROM r WHERE rn = 1""",
)
def last_wins(spark, d):
    """WIN-1, JOIN-2."""
    last = T.last_per_key(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_shipdate"])
    return last.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag")


_VAULT_SQL = f"""{REPORTS_SQL}, b AS (
  SELECT {_HUB} AS hub, source, {_PK} AS pk, 'full-' || source AS batch_id FROM reports
  UNION ALL
  SELECT {_HUB}, source, {_PK}, 'again-' || lang FROM reports WHERE doc_id IN (SELECT doc_id FROM labels))"""


def _vault(spark, d):
    """Hub, link, event and satellite after a full load and a second load of the labelled documents."""
    rows = reports(spark, d)
    again = rows.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")
    loads = rows.withColumn("batch_id", F.concat(F.lit("full-"), "source")).unionByName(
        again.withColumn("batch_id", F.concat(F.lit("again-"), "lang"))
    )
    path = F.concat(F.lit("s3://bronze/"), "batch_id")
    loads = loads.select(
        K.hub_hash(F.col("source"), _key()).alias(B.HUB_KEY), F.col("source").alias("source_name"),
        _key().alias("source_primary_key"), "batch_id", path.alias("s3_path"),
    )
    events = B.load_events(loads, "batch_id", "s3_path", LOAD_TS)
    event_id = K.surrogate_id(F.lit("report_history"), "batch_id", "s3_path")
    hub = T.first_per_key(loads.select(B.HUB_KEY, "source_name", "source_primary_key"), [B.HUB_KEY])
    return hub, B.links(loads, event_id), events, B.satellites(hub, LOAD_TS)


@query(
    "vault_join",
    f"""WITH {_VAULT_SQL}
SELECT hub AS document_hub_hash_key, pk AS source_primary_key, batch_id, 's3://bronze/' || batch_id AS s3_path FROM b""",
)
def vault_join(spark, d):
    """JOIN-1, FLT-1: one row per hub and load event."""
    hub, link, event, satellite = _vault(spark, d)
    out = B.registry(hub, link, event, satellite)
    return out.select(B.HUB_KEY, "source_primary_key", "batch_id", "s3_path")


@query(
    "load_events",
    """WITH e AS (SELECT strftime(o_orderdate, '%Y-%m') AS batch_id, count(*) AS record_count FROM orders GROUP BY 1)
SELECT sha256('report_history||' || batch_id || '||s3://bronze/' || batch_id) AS bronze_rdb_event_id,
  'report_history' AS table_name, batch_id, 's3://bronze/' || batch_id AS s3_path, record_count,
  'snapshot' AS change_operation, '2026-01-02 03:04:05' AS event_dts FROM e""",
)
def load_events(spark, d):
    """VLT-2, SNK-4, AGG-11, DAT-2."""
    month = F.date_format("o_orderdate", "yyyy-MM")
    orders = table(spark, d, "orders").select(month.alias("month"))
    events = B.load_events(orders, "month", F.concat(F.lit("s3://bronze/"), "month"), LOAD_TS)
    return events.withColumn("event_dts", F.date_format("event_dts", "yyyy-MM-dd HH:mm:ss"))


@query(
    "missing_row_defaults",
    """WITH last AS (SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1),
o AS (SELECT o.o_custkey, o.o_orderkey, o.o_totalprice,
  CASE WHEN o.o_orderstatus = 'P' THEN NULL ELSE o.o_orderpriority END AS priority
  FROM orders o JOIN last l ON o.o_orderkey = l.o_orderkey)
SELECT c.c_custkey, CASE WHEN o.o_custkey IS NULL THEN 'A' ELSE o.priority END AS priority,
  CASE WHEN o.o_custkey IS NULL THEN 0.0 ELSE o.o_totalprice END AS price, 'NX01' AS model
FROM customer c LEFT JOIN o ON c.c_custkey = o.o_custkey""",
)
def missing_row_defaults(spark, d):
    """PRJ-1, PRJ-2: default for a missing row or column, not for a NULL."""
    orders = table(spark, d, "orders").select(
        F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice",
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("priority"),
    )
    last = T.last_per_key(orders, ["c_custkey"], ["o_orderkey"]).withColumn("_found", F.lit(True))
    joined = table(spark, d, "customer").select("c_custkey").join(last, "c_custkey", "left")
    joined = T.with_defaults(joined, {"model": "NX01", "priority": "A"})
    return joined.select(
        "c_custkey",
        T.default_when_missing("_found", F.col("priority"), "A").alias("priority"),
        T.default_when_missing("_found", F.col("o_totalprice"), 0.0).alias("price"),
        "model",
    )


@query(
    "batch_write",
    "SELECT source AS batch_id, count(*) AS record_count, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY 1",
)
def batch_write(spark, d):
    """SNK-1, SRC-1, AGG-11: written per batch twice, the second time over the first, and read back."""
    docs = table(spark, d, "documents").withColumn("batch_id", F.col("source"))
    root = work_path(spark, "batches")
    batches.write_batch(docs.where("lang = 'en'"), root)
    batches.write_batch(docs, root)
    back = batches.read_batch(spark, root, docs.schema)
    return back.groupBy("batch_id").agg(F.count("*").alias("record_count"), F.sum("n_chars").alias("chars"))


@query(
    "collector_write",
    f"""WITH {REPORTS_SQL}
SELECT source AS source_name, '2026-01-02' AS load_date, {_PK} AS primary_key, {_HUB} AS row_hash FROM reports""",
)
def collector_write(spark, d):
    """SNK-2."""
    rows = reports(spark, d).select(F.col("source").alias("source_name"), _key().alias("primary_key"), "content")
    root = work_path(spark, "collected")
    batches.write_collected(rows, root, K.hub_hash(F.col("source_name"), "primary_key"), F.lit("2026-01-02"))
    back = spark.read.parquet(root)
    return back.select("source_name", F.col("load_date").cast("string").alias("load_date"), "primary_key", "row_hash")


@query(
    "parquet_probe",
    """SELECT r.doc_id, d.doc_id IS NOT NULL AS found, d.n_chars FROM
(SELECT doc_id, source FROM documents UNION ALL SELECT -1 - doc_id, 'src0' FROM labels) r
LEFT JOIN documents d ON r.doc_id = d.doc_id""",
)
def parquet_probe(spark, d):
    """SRC-2, SRC-3, JOIN-2: rows of a registry looked up by file folder and key in one scan of all batches."""
    docs = table(spark, d, "documents")
    root = work_path(spark, "probe")
    batches.write_batch(docs.select("doc_id", "n_chars", F.col("source").alias("batch_id")), root)
    stored = batches.with_path(spark.read.parquet(root)).select(
        F.substring_index("s3_path", "/", -1).alias("folder"), "doc_id", "n_chars"
    )
    last = T.last_per_key(stored, ["folder", "doc_id"], ["n_chars"]).withColumn("_found", F.lit(True))
    registry = docs.select("doc_id", "source").unionByName(
        table(spark, d, "labels").select((-1 - F.col("doc_id")).alias("doc_id"), F.lit("src0").alias("source"))
    )
    registry = registry.select("doc_id", F.concat(F.lit("batch_id="), "source").alias("folder"))
    return registry.join(last, ["folder", "doc_id"], "left").select(
        "doc_id", F.col("_found").isNotNull().alias("found"), "n_chars"
    )


@query(
    "batch_parity",
    """WITH k AS (SELECT l_orderkey, l_linenumber, l_quantity, l_shipdate FROM lineitem),
u AS (SELECT DISTINCT * FROM k)
SELECT (SELECT count(*) FROM k) AS rows_a, (SELECT count(*) FROM u) AS rows_b,
  (SELECT count(*) FROM (SELECT * FROM k EXCEPT ALL SELECT * FROM u)) AS only_a,
  (SELECT count(*) FROM (SELECT * FROM u EXCEPT ALL SELECT * FROM k)) AS only_b, true AS same_columns""",
)
def batch_parity(spark, d):
    """AGG-12: a load against the same load without repeated rows."""
    a = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate")
    return B.parity(a, a.distinct(), a.columns)


@query(
    "locator_parse",
    r"""WITH p AS (SELECT page_id, 's3://' || regexp_replace(url, '^[a-z]+://', '') AS path, url FROM pages)
SELECT page_id, split_part(substr(path, 6), '/', 1) AS bucket,
  CASE WHEN strpos(substr(path, 6), '/') = 0 THEN '' ELSE substr(path, 6 + strpos(substr(path, 6), '/')) END AS key,
  url AS first_part, regexp_replace(url, '^http://', '') AS no_prefix,
  'cdc://' || url || '/' || CAST(page_id AS VARCHAR) AS stream_locator FROM p""",
)
def locator_parse(spark, d):
    """STR-9, STR-10, STR-13, KEY-9."""
    path = F.concat(F.lit("s3://"), F.regexp_replace("url", "^[a-z]+://", ""))
    pages = table(spark, d, "pages").select("page_id", "url", path.alias("path"))
    return pages.select(
        "page_id",
        K.locator_bucket("path").alias("bucket"),
        K.locator_key("path").alias("key"),
        K.first_key_part(K.business_key("url", "page_id")).alias("first_part"),
        strip_prefix("url", "http://").alias("no_prefix"),
        K.stream_locator("url", "page_id").alias("stream_locator"),
    )


@query(
    "snapshot_diff",
    """WITH b AS (SELECT o_orderkey, o_totalprice, o_orderstatus, epoch_us(CAST(o_orderdate AS TIMESTAMP)) AS t FROM orders),
a AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
  o_orderstatus, epoch_us(CAST(o_orderdate AS TIMESTAMP)) + CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE 0 END AS t
  FROM orders WHERE o_orderpriority <> '1-URGENT'
  UNION ALL SELECT -1 - c_custkey, c_acctbal, 'N', 0 FROM customer)
SELECT coalesce(b.o_orderkey, a.o_orderkey) AS o_orderkey,
  CASE WHEN b.o_orderkey IS NULL THEN 'INSERT' WHEN a.o_orderkey IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS operation
FROM b FULL JOIN a ON a.o_orderkey = b.o_orderkey
WHERE b.o_orderkey IS NULL OR a.o_orderkey IS NULL OR a.o_totalprice <> b.o_totalprice OR a.t <> b.t""",
)
def snapshot_diff(spark, d):
    """CDC-8; some rows differ by a microsecond only."""
    micros = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    before = table(spark, d, "orders").select(
        "o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority", F.timestamp_micros(micros).alias("at"))
    later = F.timestamp_micros(F.unix_micros("at") + F.when(F.col("o_orderkey") % 10 == 0, 1).otherwise(0))
    price = F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    after = (
        before.where("o_orderpriority <> '1-URGENT'")
        .select("o_orderkey", price.alias("o_totalprice"), "o_orderstatus", later.alias("at"))
        .unionByName(
            table(spark, d, "customer").select(
                (-1 - F.col("c_custkey")).alias("o_orderkey"), F.col("c_acctbal").alias("o_totalprice"),
                F.lit("N").alias("o_orderstatus"), F.timestamp_micros(F.lit(0)).alias("at"),
            )
        )
    )
    return T.snapshot_diff(before, after, ["o_orderkey"], ["o_totalprice", "o_orderstatus", "at"])
