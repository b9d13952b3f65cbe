"""Queries over log lines, names and text columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from quayline.functions import names, text
from quayline.operators import projections as p
from quayline.operators.running import running_sum
from quayline.plans.inputs import table
from quayline.sources.events import decode_tsv

# Asked for in this order; the service sends them in canonical order.
LOG_FIELDS = ["cs-uri-query", "cs-method", "c-ip", "timestamp", "x-edge-request-id"]
PRIORITIES = ["3-MEDIUM", "1-URGENT", "5-LOW"]


def tsv_lines(spark, sf_dir):
    """Events as the service writes them: tab-separated, canonical order."""
    return table(spark, sf_dir, "events").select(
        "event_id", F.concat_ws("\t", F.col("ts").cast("string"), "user_id", "event_type", "event_id", "props").alias("line")
    )


def _plain(df):
    return df.select(*[F.col(f"`{c}`").alias(c.replace("-", "_")) for c in df.columns])


def tsv_decode(spark, sf_dir):
    return _plain(decode_tsv(tsv_lines(spark, sf_dir), "line", LOG_FIELDS).drop("extra_values"))


def tsv_uneven(spark, sf_dir):
    """Lines with fewer values than names, and with more, by event type."""
    rows = table(spark, sf_dir, "events")
    line = F.when(F.col("event_type") == "view", F.concat_ws("\t", "user_id", "event_type")).when(
        F.col("event_type") == "click", F.concat_ws("\t", "user_id", "event_type", "props", "event_id", "event_id")
    )
    lines = rows.select("event_id", line.otherwise(F.concat_ws("\t", "user_id", "event_type", "props")).alias("line"))
    return _plain(decode_tsv(lines, "line", ["cs-uri-query", "c-ip", "cs-method"])).withColumn(
        "extra_values", F.col("extra_values").cast("bigint")
    )


def select_fields(spark, sf_dir):
    """Chosen log fields of a wider decoded log, in canonical order."""
    return _plain(p.select_fields(decode_tsv(tsv_lines(spark, sf_dir), "line", LOG_FIELDS), ["cs-method", None, "timestamp"]))


def sample_50(spark, sf_dir):
    return p.sample_percent(table(spark, sf_dir, "events"), "event_id", 50).select("event_id", "event_type")


def mask_text(spark, sf_dir):
    masked = p.mask_columns(table(spark, sf_dir, "customer"), ["c_name", "c_mktsegment"])
    return masked.select("c_custkey", "c_name", "c_mktsegment", text.mask(F.lit("secret"), "full").alias("key"))


def stringify(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    return p.stringify(rows)


def safe_names(spark, sf_dir):
    raw = F.concat("p_brand", F.lit("_"), "p_name", F.lit("__"), "p_type", F.lit("!"), "p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", names.safe_name(raw).alias("name"))


def safe_names_text(spark, sf_dir):
    """Names out of whole texts in several languages."""
    return table(spark, sf_dir, "documents").select(
        "doc_id", names.safe_name("text").alias("name"), text.sha256_hex("text").alias("hash")
    )


def url_parts(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    site = F.regexp_extract("url", "^(https?://[^/]+)", 1)
    endpoint = names.delivery_endpoint(
        site, F.lit("acme"), F.lit("web logs"), F.concat(F.lit("page%5F"), "page_id"), F.array(F.lit("timestamp"), F.lit("c-ip"))
    )
    made = pages.select("page_id", "url", endpoint.alias("endpoint"))
    path = F.col("endpoint")
    path = F.regexp_replace(path, "^https?://[^/]+", "")
    return made.select(
        "page_id",
        "endpoint",
        names.base_url("endpoint").alias("base"),
        names.base_url("url").alias("same_url"),
        names.query_value("url", "page").alias("page"),
        names.query_value("url", "utm_source").alias("utm_source"),
        names.query_value("endpoint", "columns").alias("columns"),
        names.endpoint_part(path, "org").alias("org"),
        names.endpoint_part(path, "project").alias("project"),
        names.endpoint_part(path, "table").alias("table"),
        names.is_delivery_path(path).alias("delivery"),
    )


def dest_names(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    return parts.select(
        "p_partkey",
        names.destination_name(F.lower("p_type"), F.replace("p_name", F.lit(" "), F.lit("_"))).alias("destination"),
        names.quote_identifier(F.concat("p_name", F.lit('"'), "p_brand")).alias("quoted"),
    )


def quoted_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", names.quote_identifier("html").alias("quoted"))


def value_rules(spark, sf_dir):
    """First set value, first non-empty value, lenient counts, hour paths."""
    events = table(spark, sf_dir, "events")
    blank = F.when(F.col("event_type") == "click", "").when(F.col("event_type") != "view", F.col("event_type"))
    number = F.when(F.col("event_type") == "view", F.concat(F.lit("  "), F.col("event_id").cast("string"), F.lit(" rows")))
    number = number.when(F.col("event_type") == "click", "none").otherwise(F.concat(F.lit("-"), F.col("event_id").cast("string")))
    return events.select(
        "event_id",
        text.first_set(blank, F.lit("default")).alias("first_set"),
        text.first_non_empty(blank, F.lit("default")).alias("first_non_empty"),
        text.lenient_count(number).alias("cnt"),
        text.hour_path("ts").alias("hour"),
        text.millis_timestamp(F.unix_millis(F.col("ts").cast("timestamp"))).cast("timestamp_ntz").alias("at"),
    )


def trimmed_lines(spark, sf_dir):
    """All non-blank lines of all texts, trimmed of any Unicode white space."""
    docs = table(spark, sf_dir, "documents")
    padded = F.concat(F.lit("　\t"), F.replace("text", F.lit("\n"), F.lit(" \n \n ")), F.lit("\r "))
    lines = F.transform(F.split(text.trim_space(padded), "\n", -1), lambda x: text.trim_space(x))
    found = docs.select("doc_id", F.posexplode(F.filter(lines, lambda x: x != "")).alias("pos", "line"))
    return found.groupBy("doc_id").agg(
        F.count("*").alias("lines"), F.sum(F.length("line")).cast("bigint").alias("chars"), F.min("line").alias("least")
    )


def url_encoded(spark, sf_dir):
    """Whole texts as query values, and back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", text.url_encode_query("text").alias("encoded"))
    back = text.url_decode_plus("encoded") == F.col("text")
    return docs.select("doc_id", "encoded", back.alias("same"))


def rank_order(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.lit(1).alias("one"))
    ranked = orders.withColumn("rank", p.rank_of("o_orderpriority", PRIORITIES).cast("bigint"))
    placed = running_sum(ranked, ["rank"], "o_orderkey", "one", "pos", ties=["o_orderpriority"])
    ordered = p.order_by_rank(placed, "o_orderpriority", PRIORITIES, "o_orderkey")
    return ordered.select("o_orderkey", "o_orderpriority", "rank", "pos")


def sorted_entries(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    entries = F.create_map(
        F.lit("x-user"), F.array(F.col("user_id").cast("string")),
        F.lit("accept"), F.array("event_type", "props", "event_type"),
        F.lit("host"), F.array("event_type"),
    )
    rows = p.sorted_entries(events.select("event_id", entries.alias("headers")), "headers")
    return rows.select(
        "event_id", F.col("pos").cast("bigint").alias("pos"), "name", F.col("value_pos").cast("bigint").alias("value_pos"), "value"
    )


QUERIES = {
    "tsv_decode": tsv_decode,
    "tsv_uneven": tsv_uneven,
    "select_fields": select_fields,
    "sample_50": sample_50,
    "mask_text": mask_text,
    "stringify": stringify,
    "safe_names": safe_names,
    "safe_names_text": safe_names_text,
    "url_parts": url_parts,
    "dest_names": dest_names,
    "quoted_pages": quoted_pages,
    "value_rules": value_rules,
    "trimmed_lines": trimmed_lines,
    "url_encoded": url_encoded,
    "rank_order": rank_order,
    "sorted_entries": sorted_entries,
}


def _safe(raw: str) -> str:
    """Oracle of a safe name, for an SQL expression."""
    cleaned = f"regexp_replace(regexp_replace(replace(lower({raw}), '_', '-'), '[^a-z0-9-]', '', 'g'), '-+', '-', 'g')"
    return f"rtrim(left(ltrim({cleaned}, '-'), 31), '-') || '-' || left(sha256({raw}), 8)"


_SPACE = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(32)||chr(133)||chr(160)||chr(5760)||" + "||".join(
    f"chr({c})" for c in (*range(8192, 8203), 8232, 8233, 8239, 8287, 12288)
)

ORACLES = {
    "tsv_decode": """
        SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') ||
                 CASE WHEN epoch_us(ts) % 1000000 = 0 THEN ''
                      ELSE '.' || rtrim(strftime(ts, '%f'), '0') END AS "timestamp",
               CAST(user_id AS VARCHAR) AS c_ip, event_type AS cs_method,
               CAST(event_id AS VARCHAR) AS x_edge_request_id, props AS cs_uri_query
        FROM events""",
    "tsv_uneven": """
        SELECT event_id, CAST(user_id AS VARCHAR) AS c_ip, event_type AS cs_method,
               CASE WHEN event_type <> 'view' THEN props END AS cs_uri_query,
               CAST(CASE WHEN event_type = 'click' THEN 2 ELSE 0 END AS BIGINT) AS extra_values
        FROM events""",
    "select_fields": """
        SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') ||
                 CASE WHEN epoch_us(ts) % 1000000 = 0 THEN ''
                      ELSE '.' || rtrim(strftime(ts, '%f'), '0') END AS "timestamp",
               event_type AS cs_method
        FROM events""",
    "sample_50": """
        SELECT event_id, event_type FROM events
        WHERE CAST('0x' || substr(sha256(CAST(event_id AS VARCHAR)), 1, 8) AS BIGINT) % 100 < 50""",
    "mask_text": """
        SELECT c_custkey,
               CASE WHEN length(c_name) > 12 THEN left(c_name, 6) || '...' || right(c_name, 6) ELSE c_name END AS c_name,
               CASE WHEN length(c_mktsegment) > 12 THEN left(c_mktsegment, 6) || '...' || right(c_mktsegment, 6)
                    ELSE c_mktsegment END AS c_mktsegment,
               '***' AS key
        FROM customer""",
    "stringify": """
        SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus,
               strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderpriority
        FROM orders""",
    "safe_names": f"""
        SELECT p_partkey, {_safe("(p_brand || '_' || p_name || '__' || p_type || '!' || p_partkey)")} AS name FROM part""",
    "safe_names_text": f"SELECT doc_id, {_safe('text')} AS name, sha256(text) AS hash FROM documents",
    "url_parts": """
        WITH made AS (
          SELECT page_id, url, regexp_extract(url, '^(https?://[^/]+)', 1) AS site FROM pages)
        SELECT page_id,
               site || '/v1/acme/web logs/tables/page%5F' || page_id || '?transform=firehose&columns=timestamp,c-ip' AS endpoint,
               site AS base, url AS same_url,
               CASE WHEN regexp_matches(url, '[?&]page=') THEN regexp_extract(url, '[?&]page=([^&#]*)', 1) END AS page,
               CASE WHEN regexp_matches(url, '[?&]utm_source=')
                    THEN regexp_extract(url, '[?&]utm_source=([^&#]*)', 1) END AS utm_source,
               'timestamp,c-ip' AS columns, 'acme' AS org, 'web logs' AS project, 'page_' || page_id AS "table",
               true AS delivery
        FROM made""",
    "dest_names": """
        SELECT p_partkey,
               replace(lower(p_type), '_', '__') || '_' || replace(replace(p_name, ' ', '_'), '_', '__') AS destination,
               '"' || replace(p_name || '"' || p_brand, '"', '""') || '"' AS quoted
        FROM part""",
    "quoted_pages": """SELECT page_id, '"' || replace(html, '"', '""') || '"' AS quoted FROM pages""",
    "value_rules": """
        SELECT event_id,
               CASE WHEN event_type = 'click' THEN '' WHEN event_type <> 'view' THEN event_type ELSE 'default' END AS first_set,
               CASE WHEN event_type IN ('click', 'view') THEN 'default' ELSE event_type END AS first_non_empty,
               CASE WHEN event_type = 'view' THEN event_id WHEN event_type = 'click' THEN NULL ELSE -event_id END AS cnt,
               strftime(ts, '%Y/%m/%d/%H') AS hour,
               date_trunc('millisecond', ts) AS at
        FROM events""",
    "trimmed_lines": f"""
        WITH lines AS (
          SELECT doc_id, trim(unnest(string_split(text, chr(10))), {_SPACE}) AS line FROM documents)
        SELECT doc_id, count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS chars, min(line) AS least
        FROM lines WHERE line <> '' GROUP BY doc_id""",
    "url_encoded": "SELECT doc_id, replace(url_encode(text), '%20', '+') AS encoded, true AS same FROM documents",
    "rank_order": """
        WITH ranked AS (
          SELECT o_orderkey, o_orderpriority,
                 CAST(CASE o_orderpriority WHEN '3-MEDIUM' THEN 1 WHEN '1-URGENT' THEN 2 WHEN '5-LOW' THEN 3
                      ELSE 4 END AS BIGINT) AS rank
          FROM orders)
        SELECT *, row_number() OVER (PARTITION BY rank ORDER BY o_orderkey) AS pos FROM ranked""",
    "sorted_entries": """
        SELECT event_id, CAST(0 AS BIGINT) AS pos, 'accept' AS name, CAST(0 AS BIGINT) AS value_pos, event_type AS value FROM events
        UNION ALL SELECT event_id, 0, 'accept', 1, props FROM events
        UNION ALL SELECT event_id, 0, 'accept', 2, event_type FROM events
        UNION ALL SELECT event_id, 1, 'host', 0, event_type FROM events
        UNION ALL SELECT event_id, 2, 'x-user', 0, CAST(user_id AS VARCHAR) FROM events""",
}
