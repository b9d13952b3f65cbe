"""Queries over object notifications and ingest logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from quayline.operators import filters, outcomes
from quayline.plans.inputs import notifications, table
from quayline.sources.events import object_events

FILTER = {"prefix": "src1", "fmt": "json", "pattern": "doc [0-9]*[13579] "}


def object_events_query(spark, sf_dir):
    return object_events(notifications(spark, sf_dir)).drop("body")


def event_classify(spark, sf_dir):
    judged = filters.classify_events(object_events(notifications(spark, sf_dir)), **FILTER)
    return judged.select("doc_id", "key", "status", "reason")


def event_summary(spark, sf_dir):
    return filters.event_summary(filters.classify_events(object_events(notifications(spark, sf_dir)), **FILTER))


def event_match(spark, sf_dir):
    events = object_events(notifications(spark, sf_dir))
    return filters.match_events(events, buckets=["en", "fr", "de"], key_prefix="src1").select("doc_id", "bucket", "raw_key")


def event_filter(spark, sf_dir):
    events = filters.valid_events(object_events(notifications(spark, sf_dir)))
    kept = filters.filter_objects(events, "key", "csv", "src", "[05] ", internal_prefixes=["src2/"])
    return kept.select("doc_id", "key")


def ingest_log(spark, sf_dir):
    """Conversations as the event log of one object each: the user's turns start,
    the assistant's report progress; short user turns are errors."""
    turns = table(spark, sf_dir, "conversations")
    kind = (
        F.when((F.col("role") == "user") & (F.length("text") < 100), "error")
        .when(F.col("role") == "system", " ")
        .when(F.col("role") == "user", "progress")
        .otherwise("done")
    )
    return turns.select(
        F.col("conv_id").alias("key"), F.col("turn").alias("seq"), kind.alias("type"), F.col("text").alias("payload")
    )


def ingest_outcome(spark, sf_dir):
    return outcomes.ingest_outcome(ingest_log(spark, sf_dir))


def batch_summary(spark, sf_dir):
    return outcomes.batch_summary(outcomes.ingest_outcome(ingest_log(spark, sf_dir)))


def document_catalog(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.col("n_chars").alias("modified"))


def label_log(spark, sf_dir):
    """Labels as results of loading documents; toxic ones failed.  Documents of
    odd length changed since, so their entry is older than they are."""
    labels = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "key")
    return labels.select("key", (F.col("toxic") == 0).alias("ok"))


def pending_objects(spark, sf_dir):
    catalog = document_catalog(spark, sf_dir)
    log = label_log(spark, sf_dir).join(catalog, "key").select("key", "ok", "modified")
    return outcomes.ingest_pending(catalog, log)


def reconcile(spark, sf_dir):
    """Labelled documents against the catalog of good ones."""
    catalog = document_catalog(spark, sf_dir).where("modified > 1000")
    return outcomes.reconcile(catalog, label_log(spark, sf_dir))


def count_growth(spark, sf_dir):
    """Turns per role in short texts, then in all texts."""
    turns = table(spark, sf_dir, "conversations").withColumnRenamed("role", "table")
    counts = lambda rows: rows.groupBy("table").agg(F.count("*").alias("cnt"))
    before = counts(turns.where(F.col("table") != "system").where(F.length("text") < 200))
    return outcomes.count_growth(before, counts(turns), delta=20)


def min_rows(spark, sf_dir):
    return outcomes.expect_min_rows(table(spark, sf_dir, "lineitem"), 50_000)


def key_quality(spark, sf_dir):
    return outcomes.key_quality(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


QUERIES = {
    "object_events": object_events_query,
    "event_classify": event_classify,
    "event_summary": event_summary,
    "event_match": event_match,
    "event_filter": event_filter,
    "ingest_outcome": ingest_outcome,
    "batch_summary": batch_summary,
    "pending_objects": pending_objects,
    "reconcile": reconcile,
    "count_growth": count_growth,
    "min_rows": min_rows,
    "key_quality": key_quality,
}

_SENT = """
    WITH sent AS (
      SELECT doc_id,
             CASE WHEN source <> 'src1' AND lang <> 'es' THEN lang ELSE '' END AS bucket,
             CASE WHEN lang = 'de' THEN 'Object Deleted' ELSE 'Object Created' END AS detail_type,
             CASE WHEN source = 'src1' THEN '' ELSE
               source || '/doc+' || doc_id || '%20' || n_chars ||
               CASE WHEN n_chars < 1000 THEN '.JSON' WHEN n_chars < 2000 THEN '.jsonl.gz'
                    WHEN n_chars < 4000 THEN '.csv' ELSE '.txt' END END AS raw_key
      FROM documents),
    decoded AS (SELECT *, replace(replace(raw_key, '+', ' '), '%20', ' ') AS key FROM sent)"""

_JUDGED = _SENT + """,
    judged AS (
      SELECT doc_id, key,
             CASE WHEN bucket = '' OR key = '' THEN 'invalid event'
                  WHEN NOT starts_with(key, 'src1') THEN 'prefix mismatch'
                  WHEN NOT regexp_matches(lower(key), '[.](json|json[.]gz|jsonl|jsonl[.]gz|ndjson|ndjson[.]gz)$')
                    THEN 'format mismatch'
                  WHEN NOT regexp_matches(key, 'doc [0-9]*[13579] ') THEN 'pattern mismatch'
             END AS reason
      FROM decoded)"""

_LOG = """
    WITH log AS (
      SELECT conv_id, turn, text,
             CASE WHEN role = 'user' AND length(text) < 100 THEN 'error'
                  WHEN role = 'system' THEN NULL
                  WHEN role = 'user' THEN 'progress' ELSE 'done' END AS type
      FROM conversations),
    outcome AS (
      SELECT conv_id AS key,
             count(*) FILTER (type = 'error') = 0 AS ok,
             coalesce(arg_min(type, turn) FILTER (type = 'error'),
                      arg_max(type, turn) FILTER (type IS NOT NULL)) AS last_type,
             coalesce(arg_min(text, turn) FILTER (type = 'error'),
                      arg_max(text, turn) FILTER (type IS NOT NULL)) AS last_payload
      FROM log GROUP BY conv_id)"""

ORACLES = {
    "object_events": _SENT + """
        SELECT doc_id, 'aws.s3' AS source, detail_type, bucket, raw_key, key FROM decoded""",
    "event_classify": _JUDGED + """
        SELECT doc_id, key, CASE WHEN reason IS NULL THEN 'ingested' ELSE 'skipped' END AS status, reason
        FROM judged""",
    "event_summary": _JUDGED + """
        SELECT CASE WHEN reason IS NULL THEN 'ingested' ELSE 'skipped' END AS status, reason, count(*) AS events
        FROM judged GROUP BY ALL""",
    "event_match": _SENT + """
        SELECT doc_id, bucket, raw_key FROM decoded
        WHERE detail_type = 'Object Created' AND bucket IN ('en', 'fr', 'de') AND starts_with(raw_key, 'src1')""",
    "event_filter": _SENT + """
        SELECT doc_id, key FROM decoded
        WHERE bucket <> '' AND key <> '' AND starts_with(key, 'src') AND NOT starts_with(key, 'src2/')
          AND (lower(key) LIKE '%.csv' OR lower(key) LIKE '%.csv.gz') AND regexp_matches(key, '[05] ')""",
    "ingest_outcome": _LOG + " SELECT key, ok, last_type, last_payload FROM outcome",
    "batch_summary": _LOG + """
        SELECT count(*) AS matched, count(*) FILTER (ok) AS ok, count(*) FILTER (NOT ok) AS errors,
               count(*) FILTER (NOT ok) > 0 AS failed
        FROM outcome""",
    "pending_objects": """
        SELECT doc_id AS key, n_chars AS modified FROM documents
        WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 0)""",
    "reconcile": """
        SELECT coalesce(d.doc_id, l.doc_id) AS key,
               CASE WHEN d.doc_id IS NULL THEN 'unexpected' WHEN l.doc_id IS NULL THEN 'missing'
                    WHEN l.toxic = 0 THEN 'ok' ELSE 'failed' END AS state
        FROM (SELECT * FROM documents WHERE n_chars > 1000) d FULL JOIN labels l ON d.doc_id = l.doc_id""",
    "count_growth": """
        WITH a AS (SELECT role, count(*) AS cnt FROM conversations GROUP BY role),
             b AS (SELECT role, count(*) AS cnt FROM conversations
                   WHERE role <> 'system' AND length(text) < 200 GROUP BY role)
        SELECT a.role AS "table", coalesce(b.cnt, 0) AS before, a.cnt AS after,
               a.cnt >= coalesce(b.cnt, 0) + 20 AS grew
        FROM a LEFT JOIN b ON a.role = b.role""",
    "min_rows": "SELECT count(*) AS cnt, count(*) >= 50000 AS enough FROM lineitem",
    "key_quality": """
        WITH k AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL)
        SELECT CAST(coalesce(sum(n) FILTER (l_orderkey IS NULL OR l_linenumber IS NULL), 0) AS BIGINT) AS empty,
               count(*) FILTER (n > 1) AS dup
        FROM k""",
}
