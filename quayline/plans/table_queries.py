"""Queries over tables: counts, backups, routes, defaults, differences."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from quayline.operators import backups, diffs, routing, tables
from quayline.operators.outcomes import count_growth
from quayline.plans.inputs import table
from quayline.session import run_folder

BACKUP_SCHEMA = "event_id bigint, user_id bigint, event_type string, value double, props string, at timestamp"
NOON = datetime(2024, 1, 10, 12, 0)
END = datetime(2024, 1, 20, 0, 30)


def count_table(spark, sf_dir):
    root = run_folder(spark, "lake")
    tables.append_table(table(spark, sf_dir, "lineitem"), root, "lines", "first")
    known = tables.count_table(spark, root, "lines").select(F.lit("lines").alias("name"), "cnt")
    return known.union(tables.count_table(spark, root, "nothing").select(F.lit("nothing"), "cnt"))


def sql_count(spark, sf_dir):
    """The count query of each table, asked in Spark SQL over the documents."""
    root = run_folder(spark, "lake")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    tables.append_table(orders, root, "orders_log", "first")
    tables.create_table_view(spark, root, "orders_log")
    tables.create_table_view(spark, root, "orders_log", "o_custkey bigint, o_orderpriority string", "orders_typed")
    return spark.sql(
        """SELECT 'all' AS part, (SELECT count(*) AS cnt FROM orders_log) AS cnt
           UNION ALL SELECT o_orderpriority, count(*) FROM orders_typed WHERE o_custkey > 100 GROUP BY o_orderpriority"""
    )


def evolved_table(spark, sf_dir):
    """Three loads with other fields each, one field of unlike types, read back
    with all columns the table has by then."""
    root = run_folder(spark, "lake")
    orders = table(spark, sf_dir, "orders")
    kinds = {
        "F": orders.select("o_orderkey", "o_totalprice", F.col("o_custkey").alias("mixed")),
        "O": orders.select("o_orderkey", "o_orderpriority", F.col("o_orderpriority").alias("mixed")),
        "P": orders.select("o_orderkey", F.col("o_orderkey").alias("odd name")),
    }
    for status, rows in kinds.items():
        tables.append_table(rows.where(orders["o_orderstatus"] == status), root, "orders", status)
    return tables.read_typed(spark, root, "orders").withColumnRenamed("odd name", "odd_name")


def table_growth(spark, sf_dir):
    """Two loads of orders, one table per status: counts before and after."""
    orders = table(spark, sf_dir, "orders")
    rows = orders.select(
        tables.row_document(["o_orderkey", "o_totalprice"]).alias("doc"),
        F.lit(None).cast("string").alias("origin"),
        F.lit("acme").alias("org"),
        F.lit("shop").alias("project"),
        F.concat(F.lit("status_"), "o_orderstatus").alias("table"),
        (F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp_ntz")).alias("old"),
    )
    root = run_folder(spark, "lake")
    tables.write_routed(rows.where("old").where("table <> 'status_P'"), root, "first")
    tables.write_routed(rows.where("not old or table = 'status_P'"), root, "second")
    tables.write_routed(rows.where("not old or table = 'status_P'"), root, "second")  # repeated load
    stored = tables.read_tables(spark, root)
    counts = lambda r: r.groupBy("table").agg(F.count("*").alias("cnt"))
    return count_growth(counts(stored.where("load_id = 'first'")), counts(stored), delta=1000)


def _split(spark, sf_dir, mode):
    rows = table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp")).drop("ts")
    return backups.with_backup(rows, "value > 50", mode)


def backup_split(spark, sf_dir):
    good, failed = _split(spark, sf_dir, "FailedDataOnly")
    _, everything = _split(spark, sf_dir, "AllData")
    parts = [good.withColumn("part", F.lit("good")), failed.withColumn("part", F.lit("failed"))]
    parts.append(everything.withColumn("part", F.lit("all")))
    return parts[0].union(parts[1]).union(parts[2]).select("part", "event_id", "value")


def _written(spark, sf_dir):
    _, failed = _split(spark, sf_dir, "FailedDataOnly")
    root = run_folder(spark, "backup")
    backups.write_backup(failed, root, "at", "first")
    return root


def backup_replay(spark, sf_dir):
    rows = backups.replay_backup(spark, _written(spark, sf_dir), BACKUP_SCHEMA, "at", NOON, END)
    return rows.select("event_id", "user_id", "value", "props", F.col("at").cast("timestamp_ntz").alias("at"))


def backup_expire(spark, sf_dir):
    root = _written(spark, sf_dir)
    backups.expire_backup(spark, root, datetime(2024, 2, 9, 8, 0), days=30)
    return backups.replay_backup(spark, root, BACKUP_SCHEMA).select("event_id", "value")


def backup_live(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return backups.live_backup(events, "ts", datetime(2024, 2, 14, 8, 0)).select("event_id", "ts")


def table_diff(spark, sf_dir):
    """Orders against an edited copy: open ones are gone, urgent ones moved to a
    new key, finished ones of high price changed."""
    desired = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    moved = F.col("o_orderpriority") == "1-URGENT"
    dear = (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 250_000)
    actual = desired.where("o_orderstatus <> 'O'").select(
        F.when(moved, -F.col("o_orderkey") - 1).otherwise(F.col("o_orderkey")).alias("o_orderkey"),
        "o_orderstatus",
        F.when(dear, F.col("o_totalprice") * 2).otherwise(F.col("o_totalprice")).alias("o_totalprice"),
        F.when(dear & (F.col("o_orderpriority") == "5-LOW"), F.lit(None)).otherwise(F.col("o_orderpriority")).alias("o_orderpriority"),
    )
    found = diffs.table_diff(desired, actual, ["o_orderkey"])
    return found.select("o_orderkey", "change", F.concat_ws(",", "columns").alias("columns"))


def apply_defaults(spark, sf_dir):
    """Customers whose segment is empty take the name of their nation."""
    customers = table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.col("c_nationkey").alias("nation"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "").when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("segment"),
    )
    defaults = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_name").alias("segment"))
    return routing.apply_defaults(customers, defaults, ["nation"], ["segment"])


def route_as_of(spark, sf_dir):
    """Events to the table that was current for their type: each type gets a new
    table on every day it has an event above 150."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    switches = table(spark, sf_dir, "events").where("value > 150").groupBy(
        "event_type", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("valid_from")
    ).agg(F.min("event_id").alias("first_event"))
    routes = switches.select(
        "event_type", "valid_from", F.concat("event_type", F.date_format("valid_from", "_yyyyMMdd")).alias("table")
    )
    ranged = routing.effective_ranges(routes, "event_type")
    return routing.route_as_of(events, ranged, "event_type", "ts").select("event_id", "table")


QUERIES = {
    "count_table": count_table,
    "sql_count": sql_count,
    "evolved_table": evolved_table,
    "table_growth": table_growth,
    "backup_split": backup_split,
    "backup_replay": backup_replay,
    "backup_expire": backup_expire,
    "backup_live": backup_live,
    "table_diff": table_diff,
    "apply_defaults": apply_defaults,
    "route_as_of": route_as_of,
}

ORACLES = {
    "count_table": """
        SELECT 'lines' AS name, count(*) AS cnt FROM lineitem UNION ALL SELECT 'nothing', 0""",
    "sql_count": """
        SELECT 'all' AS part, count(*) AS cnt FROM orders
        UNION ALL SELECT o_orderpriority, count(*) FROM orders WHERE o_custkey > 100 GROUP BY o_orderpriority""",
    "evolved_table": """
        SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS o_totalprice,
               CASE o_orderstatus WHEN 'F' THEN CAST(o_custkey AS VARCHAR) WHEN 'O' THEN o_orderpriority END AS mixed,
               CASE WHEN o_orderstatus = 'O' THEN o_orderpriority END AS o_orderpriority,
               CASE WHEN o_orderstatus = 'P' THEN o_orderkey END AS odd_name
        FROM orders""",
    "table_growth": """
        WITH r AS (
          SELECT 'status_' || o_orderstatus AS "table",
                 o_orderdate < TIMESTAMP '1997-01-01' AND o_orderstatus <> 'P' AS first
          FROM orders)
        SELECT "table", count(*) FILTER (first) AS before, count(*) AS after,
               count(*) >= count(*) FILTER (first) + 1000 AS grew
        FROM r GROUP BY "table" """,
    "backup_split": """
        SELECT 'good' AS part, event_id, value FROM events WHERE NOT value > 50
        UNION ALL SELECT 'failed', event_id, value FROM events WHERE value > 50
        UNION ALL SELECT 'all', event_id, value FROM events""",
    "backup_replay": """
        SELECT event_id, user_id, value, props, ts AS at FROM events
        WHERE value > 50 AND ts >= TIMESTAMP '2024-01-10 12:00:00'
          AND ts < TIMESTAMP '2024-01-20 00:30:00'""",
    "backup_expire": """
        SELECT event_id, value FROM events WHERE value > 50 AND ts >= TIMESTAMP '2024-01-10'""",
    "backup_live": "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-15'",
    "table_diff": """
        WITH actual AS (
          SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN -o_orderkey - 1 ELSE o_orderkey END AS o_orderkey,
                 o_orderstatus,
                 CASE WHEN o_orderstatus = 'F' AND o_totalprice > 250000 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice,
                 CASE WHEN o_orderstatus = 'F' AND o_totalprice > 250000 AND o_orderpriority = '5-LOW' THEN NULL
                      ELSE o_orderpriority END AS o_orderpriority
          FROM orders WHERE o_orderstatus <> 'O'),
        joined AS (
          SELECT coalesce(d.o_orderkey, a.o_orderkey) AS o_orderkey,
                 a.o_orderkey IS NULL AS added, d.o_orderkey IS NULL AS removed,
                 concat_ws(',', CASE WHEN d.o_orderstatus IS DISTINCT FROM a.o_orderstatus THEN 'o_orderstatus' END,
                                CASE WHEN d.o_totalprice IS DISTINCT FROM a.o_totalprice THEN 'o_totalprice' END,
                                CASE WHEN d.o_orderpriority IS DISTINCT FROM a.o_orderpriority THEN 'o_orderpriority' END) AS names
          FROM orders d FULL JOIN actual a ON d.o_orderkey = a.o_orderkey)
        SELECT o_orderkey,
               CASE WHEN added THEN 'added' WHEN removed THEN 'removed' WHEN names <> '' THEN 'changed' ELSE 'same' END AS change,
               CASE WHEN added OR removed THEN '' ELSE names END AS columns
        FROM joined""",
    "apply_defaults": """
        SELECT c_custkey, c_nationkey AS nation,
               CASE WHEN c_mktsegment IN ('MACHINERY', 'BUILDING') THEN n_name ELSE c_mktsegment END AS segment
        FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""",
    "route_as_of": """
        WITH days AS (
          SELECT DISTINCT event_type, CAST(date_trunc('day', ts) AS TIMESTAMP) AS valid_from FROM events WHERE value > 150),
        ranged AS (
          SELECT *, lead(valid_from) OVER (PARTITION BY event_type ORDER BY valid_from) AS valid_to FROM days)
        SELECT event_id, r.event_type || strftime(r.valid_from, '_%Y%m%d') AS "table"
        FROM events e LEFT JOIN ranged r
          ON e.event_type = r.event_type AND e.ts >= r.valid_from AND (r.valid_to IS NULL OR e.ts < r.valid_to)""",
}
