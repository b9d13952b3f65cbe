"""Queries over delivery requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from quayline.operators import deliveries as d
from quayline.operators.batches import assign_batches
from quayline.operators.running import running_total
from quayline.operators.tables import dump_tables, table_counts, write_routed
from quayline.plans.inputs import requests, staged_parquet, table
from quayline.session import run_folder
from quayline.sources.events import delivery_requests, route
from quayline.streaming.deliveries import classified_requests, delivered_rows


def parsed(spark, sf_dir):
    return delivery_requests(requests(spark, sf_dir), "body", "header_request_id")


def delivery_parse(spark, sf_dir):
    rows = parsed(spark, sf_dir)
    return rows.select("event_id", "request_id", "sent_at", "valid_json", F.size("payloads").cast("bigint").alias("records"))


def delivery_classify(spark, sf_dir):
    judged = route(d.classify_deliveries(parsed(spark, sf_dir), "right-key"))
    return judged.select("event_id", F.col("status").cast("bigint").alias("status"), "error", "org", "project", "table")


def delivery_rows(spark, sf_dir):
    """Every line of every decodable request, with what each line holds."""
    good = parsed(spark, sf_dir).where("valid_json").where(~d.undecodable())
    lines = d.explode_records(good, keep=("event_id",))
    return lines.select(
        "event_id",
        F.col("rec_pos").cast("bigint").alias("rec_pos"),
        F.col("line_pos").cast("bigint").alias("line_pos"),
        "line",
    )


def delivery_stats(spark, sf_dir):
    good = parsed(spark, sf_dir).where("valid_json").where(~d.undecodable())
    return d.delivery_stats(good, keep=("event_id",))


def redelivered(spark, sf_dir):
    """Requests with those of purchases and errors sent twice, one second later."""
    rows = parsed(spark, sf_dir).where("valid_json")
    times = F.when(F.col("event_type").isin("purchase", "error"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("event_id", "event_type", "request_id", "sent_at", F.explode(times).alias("attempt")).withColumn(
        "arrival", F.col("sent_at") + 1000 * F.col("attempt")
    )


def delivery_dedup(spark, sf_dir):
    firsts = d.dedup_requests(redelivered(spark, sf_dir), ["arrival", "event_id"])
    return firsts.select("request_id", "event_id", "arrival")


def delivery_unseen(spark, sf_dir):
    """First deliveries whose request id was not processed before; the history is
    the requests of views."""
    rows = redelivered(spark, sf_dir)
    firsts = d.dedup_requests(rows, ["arrival", "event_id"], keep_anonymous=True)
    history = parsed(spark, sf_dir).where("event_type = 'view'").select("request_id")
    return d.drop_seen(firsts, history).select("request_id", "event_id", "arrival")


def running_totals(spark, sf_dir):
    rows = parsed(spark, sf_dir).where("valid_json").where(~d.undecodable())
    stats = d.delivery_stats(rows, keep=("event_type", "event_id", "sent_at"))
    # The running total takes three passes, so the parsed numbers are stored first.
    stats = spark.read.schema(stats.schema).parquet(staged_parquet(spark, stats, "stats"))
    totals = running_total(stats, table="event_type", arrival="sent_at", tie="event_id")
    return totals.select("event_type", "event_id", "ingested", "total")


def lake(spark, sf_dir):
    judged = classified_requests(requests(spark, sf_dir), "right-key")
    first = d.dedup_requests(judged, ["sent_at", "event_id"], keys=("dedup_key",))
    root = run_folder(spark, "lake")
    write_routed(delivered_rows(first), root, "first")
    return root


def route_counts(spark, sf_dir):
    return table_counts(spark, lake(spark, sf_dir))


def table_dump(spark, sf_dir):
    dumped = dump_tables(spark, lake(spark, sf_dir))
    return dumped.select(
        "table",
        F.get_json_object("json", "$.event_id").try_cast("bigint").alias("event_id"),
        F.get_json_object("json", "$.k").try_cast("bigint").alias("k"),
        F.when(F.startswith("json", F.lit('"')), F.btrim("json", F.lit('"'))).alias("text"),
    )


def assign_batches_query(spark, sf_dir):
    """Batches of event records: 256 bytes of text or one day, both from the first record on."""
    events = table(spark, sf_dir, "events").select(
        "event_id", "event_type", "ts", (F.length("props") + F.length("event_type")).cast("bigint").alias("bytes")
    )
    return assign_batches(events, "event_type", "ts", "bytes", 256, 86_400, ["event_id"]).select(
        "event_id", "batch", "opened"
    )


QUERIES = {
    "delivery_parse": delivery_parse,
    "delivery_classify": delivery_classify,
    "delivery_rows": delivery_rows,
    "delivery_stats": delivery_stats,
    "delivery_dedup": delivery_dedup,
    "delivery_unseen": delivery_unseen,
    "running_total": running_totals,
    "route_counts": route_counts,
    "table_dump": table_dump,
    "assign_batches": assign_batches_query,
}

# What the request of an event looks like: id, validity, answer.
JUDGED = _REQ = """
    WITH req AS (
      SELECT *, epoch_us(ts) // 1000 AS sent_at,
             CASE WHEN event_type = 'signup' THEN '' ELSE 'r-' || event_id END AS request_id,
             NOT (event_type = 'purchase' AND value > 100) AS valid_json,
             event_type = 'error' AND value > 100 AS undecodable
      FROM events),
    judged AS (
      SELECT *,
             CASE WHEN event_type = 'view' AND value < 5 THEN 405
                  WHEN event_type = 'signup' AND value > 100 THEN 404
                  WHEN value > 150 THEN 403
                  WHEN NOT valid_json THEN 400
                  WHEN undecodable THEN 500 ELSE 200 END AS status
      FROM req)"""

_SENT_TWICE = _REQ + """,
    sent AS (
      SELECT event_id, event_type, request_id, sent_at AS arrival FROM req WHERE valid_json
      UNION ALL
      SELECT event_id, event_type, request_id, sent_at + 1000 FROM req
      WHERE valid_json AND event_type IN ('purchase', 'error'))"""

_STORED = _REQ + """,
    stored AS (
      SELECT event_type, event_id, props FROM judged
      WHERE status = 200 QUALIFY request_id <> '' OR row_number() OVER (PARTITION BY request_id ORDER BY sent_at, event_id) = 1)"""

ORACLES = {
    "delivery_parse": _REQ + """
        SELECT event_id, valid_json,
               CASE WHEN valid_json THEN request_id ELSE '' END AS request_id,
               CASE WHEN valid_json THEN sent_at END AS sent_at,
               CAST(CASE WHEN valid_json THEN 2 ELSE 0 END AS BIGINT) AS records
        FROM req""",
    "delivery_classify": _REQ + """
        SELECT event_id, CAST(status AS BIGINT) AS status,
               CASE status WHEN 405 THEN 'method not allowed' WHEN 404 THEN '404 page not found'
                           WHEN 403 THEN 'invalid access key' WHEN 400 THEN 'invalid JSON body'
                           WHEN 500 THEN 'base64 decode' END AS error,
               'acme' AS org, 'web' AS project, event_type AS "table"
        FROM judged""",
    "delivery_rows": _REQ + """
        SELECT event_id, CAST(0 AS BIGINT) AS rec_pos, CAST(0 AS BIGINT) AS line_pos,
               '{"event_id":' || event_id || ',"user_id":' || user_id || ',"event_type":"' || event_type || '"}' AS line
        FROM req WHERE valid_json AND NOT undecodable
        UNION ALL
        SELECT event_id, 0, 1, props FROM req WHERE valid_json AND NOT undecodable
        UNION ALL
        SELECT event_id, 1, 0, event_type FROM req WHERE valid_json AND NOT undecodable""",
    "delivery_stats": _REQ + """
        SELECT event_id, CAST(2 AS BIGINT) AS records_in_batch, CAST(3 AS BIGINT) AS ingested
        FROM req WHERE valid_json AND NOT undecodable""",
    "delivery_dedup": _SENT_TWICE + """
        SELECT request_id, event_id, arrival FROM sent
        QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY arrival, event_id) = 1""",
    "delivery_unseen": _SENT_TWICE + """
        SELECT request_id, event_id, arrival FROM sent WHERE event_type <> 'view'
        QUALIFY request_id = '' OR row_number() OVER (PARTITION BY request_id ORDER BY arrival, event_id) = 1""",
    "running_total": _REQ + """
        SELECT event_type, event_id, CAST(3 AS BIGINT) AS ingested,
               CAST(sum(3) OVER (PARTITION BY event_type ORDER BY sent_at, event_id
                                 ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total
        FROM req WHERE valid_json AND NOT undecodable""",
    "route_counts": _STORED + """
        SELECT 'acme' AS org, 'web' AS project, event_type AS "table", 3 * count(*) AS cnt
        FROM stored GROUP BY event_type""",
    "table_dump": _STORED + """
        SELECT event_type AS "table", event_id, CAST(NULL AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS text FROM stored
        UNION ALL
        SELECT event_type, NULL, CAST(json_extract_string(props, '$.k') AS BIGINT), NULL FROM stored
        UNION ALL
        SELECT event_type, NULL, NULL, event_type FROM stored""",
    "assign_batches": """
        WITH RECURSIVE numbered AS (
          SELECT event_id, event_type, ts, length(props) + length(event_type) AS bytes,
                 row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n
          FROM events),
        walk AS (
          SELECT event_id, event_type, n, ts AS opened, bytes AS held, 0 AS batch FROM numbered WHERE n = 1
          UNION ALL
          SELECT r.event_id, r.event_type, r.n,
                 CASE WHEN w.held >= 256 OR r.ts >= w.opened + INTERVAL 1 DAY THEN r.ts ELSE w.opened END,
                 CASE WHEN w.held >= 256 OR r.ts >= w.opened + INTERVAL 1 DAY THEN 0 ELSE w.held END + r.bytes,
                 w.batch + CASE WHEN w.held >= 256 OR r.ts >= w.opened + INTERVAL 1 DAY THEN 1 ELSE 0 END
          FROM walk w JOIN numbered r ON r.event_type = w.event_type AND r.n = w.n + 1)
        SELECT event_id, CAST(batch AS BIGINT) AS batch, opened FROM walk""",
}
