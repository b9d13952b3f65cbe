"""Queries over staged files: catalogs, scans, filtered reads, backfill."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayline.functions.documents import field, typed_columns
from quayline.operators.outcomes import batch_summary
from quayline.operators.tables import append_table, read_table, union_all
from quayline.plans.backfill import backfill
from quayline.plans.inputs import staged_arrays, staged_csv, staged_json, staged_parquet, table
from quayline.session import run_folder
from quayline.sources.files import read_objects, scan_csv, scan_json, scan_parquet
from quayline.sources.objects import object_catalog

EVENT_FIELDS = ["event_id", "user_id", "event_type", "value", "props"]
EVENT_TYPES = "event_id bigint, user_id bigint, event_type string, value double, props string"


def object_catalog_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    named = orders.withColumn("priority", F.concat("o_orderpriority", F.lit(" +%"))).withColumn(
        "status", F.col("o_orderstatus")
    )
    root = staged_json(spark, named.select("o_orderkey", "status", "priority"), "catalog", ("status", "priority"))
    found = object_catalog(spark, root, internal_prefixes=["status=P/"])
    folder = F.regexp_extract("key", "^status=([^/]*)/priority=([^/]*)/", 1).alias("status")
    # Spark escapes '%' in folder names; that escape is part of the key.
    label = F.regexp_extract("key", "^status=([^/]*)/priority=([^/]*)/", 2)
    return found.where(F.col("length") > 0).select(folder, F.replace(label, F.lit("%25"), F.lit("%")).alias("priority")).distinct()


def scan_json_lines(spark, sf_dir):
    root = staged_json(spark, table(spark, sf_dir, "events").select(*EVENT_FIELDS), "lines", compression="gzip")
    return scan_json(spark, root, layout="lines", schema=EVENT_TYPES)


def scan_json_array(spark, sf_dir):
    root = staged_arrays(spark, table(spark, sf_dir, "events").select(*EVENT_FIELDS), "arrays")
    return scan_json(spark, root, layout="auto", schema=EVENT_TYPES)


def scan_csv_header(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(*reversed(EVENT_FIELDS))
    root = staged_csv(spark, rows, "csv", compression="gzip", escape='"')
    return scan_csv(spark, root, schema=EVENT_TYPES)


def scan_parquet_files(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return scan_parquet(spark, staged_parquet(spark, orders, "parquet")).select(
        "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate"
    )


def read_objects_filtered(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("kind", F.col("event_type"))
    root = staged_json(spark, rows.select(*EVENT_FIELDS, "kind"), "filtered", ("kind",), compression="gzip")
    docs = read_objects(spark, root, "json", prefix="kind=", pattern="=(click|error)/part-.*z$")
    return docs.select(*typed_columns("doc", EVENT_TYPES))


def union_unlike_files(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    clicks = events.where("event_type = 'click'").select("event_id", "value")
    others = events.where("event_type <> 'click'").select("event_id", "event_type", "props")
    by_line = scan_json(spark, staged_json(spark, clicks, "clicks"), schema="event_id bigint, value double")
    by_row = scan_csv(
        spark, staged_csv(spark, others, "others", escape='"'), schema="event_id string, event_type string, props string"
    )
    return union_all([by_line, by_row])


def variant_fields(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    root = run_folder(spark, "variants")
    docs = events.select(F.to_variant_object(F.struct("event_id", F.try_parse_json("props").alias("props"))).alias("doc"))
    append_table(docs, root, "events", "first")
    rows = read_table(spark, root, "events")
    return rows.select(
        field("doc", "event_id", "bigint").alias("event_id"),
        F.try_variant_get("doc", "$.props.k", "bigint").alias("k"),
        F.try_variant_get("doc", "$.props.missing", "string").alias("missing"),
    )


def backfill_results(spark, sf_dir):
    """Rows a backfill put into its table, counted per folder of the store."""
    rows = table(spark, sf_dir, "documents").withColumn("lg", F.col("lang"))
    root = staged_json(spark, rows.select("doc_id", "text", "source", "lg"), "backfill", ("lg",))
    results = backfill(spark, root, run_folder(spark, "lake"), "docs", "json", "first", pattern="^lg=(en|fr)/")
    folders = results.withColumn("lang", F.regexp_extract("key", "^lg=([^/]*)/", 1))
    return folders.groupBy("lang").agg(F.sum("rows").alias("rows"), F.bool_and("ok").alias("ok"))


def backfill_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("state", F.col("o_orderstatus"))
    one_each = rows.select("o_orderkey", "o_custkey", "state").repartitionByRange("state")
    root = staged_csv(spark, one_each, "summary", ("state",))
    results = backfill(spark, root, run_folder(spark, "lake"), "orders", "csv", "first")
    summary = batch_summary(results, sums=["rows"])
    return summary.select((F.col("matched") == F.col("ok")).alias("all_ok"), "errors", "failed", "rows")


QUERIES = {
    "object_catalog": object_catalog_query,
    "scan_json_lines": scan_json_lines,
    "scan_json_array": scan_json_array,
    "scan_csv_header": scan_csv_header,
    "scan_parquet": scan_parquet_files,
    "read_objects_filtered": read_objects_filtered,
    "union_unlike_files": union_unlike_files,
    "variant_fields": variant_fields,
    "backfill_results": backfill_results,
    "backfill_summary": backfill_summary,
}

_EVENTS = "SELECT event_id, user_id, event_type, value, props FROM events"

ORACLES = {
    "object_catalog": """
        SELECT DISTINCT o_orderstatus AS status, o_orderpriority || ' +%' AS priority
        FROM orders WHERE o_orderstatus <> 'P'""",
    "scan_json_lines": _EVENTS,
    "scan_json_array": _EVENTS,
    "scan_csv_header": _EVENTS,
    "scan_parquet": "SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderdate FROM orders",
    "read_objects_filtered": _EVENTS + " WHERE event_type IN ('click', 'error')",
    "union_unlike_files": """
        SELECT CAST(event_id AS VARCHAR) AS event_id,
               CASE WHEN event_type = 'click' THEN value END AS value,
               CASE WHEN event_type <> 'click' THEN event_type END AS event_type,
               CASE WHEN event_type <> 'click' THEN props END AS props
        FROM events""",
    "variant_fields": """
        SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
               CAST(NULL AS VARCHAR) AS missing
        FROM events""",
    "backfill_results": """
        SELECT lang, count(*) AS rows, true AS ok FROM documents
        WHERE lang IN ('en', 'fr') GROUP BY lang""",
    "backfill_summary": """
        SELECT true AS all_ok, CAST(0 AS BIGINT) AS errors, false AS failed, count(*) AS rows FROM orders""",
}
