"""Queries over change rows and request-log rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from quayline.functions import text
from quayline.functions.documents import typed_columns
from quayline.operators import changes as c
from quayline.operators import rules as r
from quayline.operators.running import rate_exceeded, window_counts
from quayline.operators.tables import read_table, write_routed
from quayline.plans.inputs import changes, table
from quayline.session import run_folder
from quayline.sources.changes import range_predicates, snapshot_changes

DAY = 86_400
SPEECH = ("eaux", "nikto", "stre", "qu'", "und der")


def cdc_current(spark, sf_dir):
    return c.cdc_current(changes(spark, sf_dir), ["user_id"]).select("user_id", "lsn", "op", F.col("after.props").alias("props"))


def cdc_snapshot(spark, sf_dir):
    """Customers copied range by range as inserts; ranges end at key quantiles."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    bounds = customers.agg(F.percentile_approx("c_custkey", [0.25, 0.5, 0.75]).alias("q")).first()["q"]
    copied = None
    for condition in range_predicates("c_custkey", bounds):
        part = customers.where(condition)
        copied = part if copied is None else copied.unionByName(part)
    rows = snapshot_changes(copied, "public", "customer", ["c_custkey"], lsn=7)
    return rows.select("c_custkey", "op", "lsn", "schema", "table", F.col("after.c_name").alias("c_name"))


def cdc_append(spark, sf_dir):
    root = run_folder(spark, "log")
    write_routed(c.change_rows(changes(spark, sf_dir)), root, "first")
    rows = read_table(spark, root, "public_user__state")
    return rows.select("origin", *typed_columns("doc", "user_id string, event_type string, props string"))


def cdc_bootstrap_tail(spark, sf_dir):
    """State at the middle of the log plus the later changes = state at its end."""
    log = changes(spark, sf_dir)
    position = log.agg(F.max("lsn").alias("last")).first()["last"] // 2
    snapshot = c.cdc_current(log.where(F.col("lsn") <= position), ["user_id"]).drop("op", "lsn")
    return c.cdc_current(c.bootstrap_and_tail(snapshot, log, position), ["user_id"]).select(
        "user_id", F.col("after.event_type").alias("event_type"), F.col("after.props").alias("props")
    )


def cdc_publication(spark, sf_dir):
    """Changes of the published tables: one table per event type, published are
    those of an early name that hold a value above 100."""
    events = table(spark, sf_dir, "events").withColumn("schema", F.lit("public")).withColumn("table", F.col("event_type"))
    published = events.where("value > 100 and event_type < 'p'").select("schema", "table").distinct()
    return c.publication_filter(events, published).select("event_id", "table")


def cdc_changed_columns(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    names = ["o_orderstatus", "o_totalprice", "o_orderpriority"]
    done = F.col("o_orderstatus") == "F"
    after = F.struct(
        F.when(done, "O").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(F.col("o_totalprice") > 300_000, F.lit(None)).otherwise(F.col("o_totalprice")).alias("o_totalprice"),
        F.col("o_orderpriority"),
    )
    rows = orders.select(
        "o_orderkey",
        F.when(F.col("o_orderpriority") == "5-LOW", "I").otherwise("U").alias("op"),
        F.struct(*names).alias("before"),
        after.alias("after"),
    )
    return c.change_columns(rows).select("o_orderkey", F.concat_ws(",", "changed_columns").alias("columns"))


def rate_exceeded_query(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return rate_exceeded(events, ["user_id"], "ts", limit=5, seconds=DAY)


def rate_counts(spark, sf_dir):
    return window_counts(table(spark, sf_dir, "events"), ["user_id"], "ts", DAY)


def request_logs(spark, sf_dir):
    """Events as request logs: the agent is spelled from the event, its country
    from its type."""
    events = table(spark, sf_dir, "events")
    scanner = F.when(F.col("value") > 120, "SQLMap/1.7").when(F.col("value") > 90, "Mozilla (NIKTO)").otherwise("Mozilla")
    country = F.when(F.col("event_type") == "error", "KP").when(F.col("event_type") == "signup", F.lit(None)).otherwise("FR")
    return events.select(
        "event_id",
        "ts",
        F.col("user_id").alias("client_ip"),
        F.when(F.col("event_type") != "view", scanner).alias("user_agent"),
        country.alias("country"),
    )


def _daily_rules():
    rules = r.sample_rules(limit=5)
    return [r.Rule(x.name, x.priority, x.kind, x.column, x.values, x.limit, DAY) for x in rules]


def rules_eval(spark, sf_dir):
    return r.evaluate_rules(request_logs(spark, sf_dir), _daily_rules()).select("event_id", "action", "rule")


def rules_summary(spark, sf_dir):
    return r.rule_summary(r.evaluate_rules(request_logs(spark, sf_dir), _daily_rules()))


def rules_text(spark, sf_dir):
    """Text and list rules over whole documents."""
    rules = [
        r.Rule("speech", 20, "contains", "text", SPEECH),
        r.Rule("lang", 10, "in_list", "lang", ("de", "es"), action="count"),
    ]
    return r.evaluate_rules(table(spark, sf_dir, "documents"), rules).select("doc_id", "action", "rule")


def contains_any_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.contains_any("html", ["NMAP", "Nicht", "<table"]).alias("hit"))


QUERIES = {
    "cdc_current": cdc_current,
    "cdc_snapshot": cdc_snapshot,
    "cdc_append": cdc_append,
    "cdc_bootstrap_tail": cdc_bootstrap_tail,
    "cdc_publication": cdc_publication,
    "cdc_changed_columns": cdc_changed_columns,
    "rate_exceeded": rate_exceeded_query,
    "rate_counts": rate_counts,
    "rules_eval": rules_eval,
    "rules_summary": rules_summary,
    "rules_text": rules_text,
    "contains_any": contains_any_text,
}

_RATED = """
    WITH rated AS (
      SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY ts
                               RANGE BETWEEN INTERVAL 86400 SECONDS PRECEDING AND CURRENT ROW) AS requests
      FROM events)"""

_RULED = _RATED + """,
    ruled AS (
      SELECT event_id,
             CASE WHEN requests > 5 THEN 'rate-limit-per-ip'
                  WHEN event_type = 'error' THEN 'geo-block'
                  WHEN event_type <> 'view' AND value > 90 THEN 'block-suspicious-ua' END AS rule
      FROM rated)"""

ORACLES = {
    "cdc_current": """
        SELECT user_id, event_id AS lsn, CASE WHEN event_type = 'signup' THEN 'I' ELSE 'U' END AS op, props
        FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)
        WHERE event_type <> 'error'""",
    "cdc_snapshot": """
        SELECT c_custkey, 'I' AS op, CAST(7 AS BIGINT) AS lsn, 'public' AS schema, 'customer' AS "table", c_name
        FROM customer""",
    "cdc_append": """
        SELECT CASE WHEN event_type = 'error' THEN 'D' WHEN event_type = 'signup' THEN 'I' ELSE 'U' END || ':' || event_id AS origin,
               CAST(user_id AS VARCHAR) AS user_id, event_type, props
        FROM events""",
    "cdc_bootstrap_tail": """
        SELECT user_id, event_type, props
        FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)
        WHERE event_type <> 'error'""",
    "cdc_publication": """
        SELECT event_id, event_type AS "table" FROM events
        WHERE event_type IN (SELECT event_type FROM events WHERE value > 100 AND event_type < 'p')""",
    "cdc_changed_columns": """
        SELECT o_orderkey,
               CASE WHEN o_orderpriority = '5-LOW' THEN ''
                    ELSE concat_ws(',', CASE WHEN o_orderstatus = 'F' THEN 'o_orderstatus' END,
                                        CASE WHEN o_totalprice > 300000 THEN 'o_totalprice' END) END AS columns
        FROM orders""",
    "rate_exceeded": _RATED + " SELECT event_id, user_id, ts, requests > 5 AS exceeded FROM rated",
    "rate_counts": _RATED + " SELECT DISTINCT user_id, ts, requests FROM rated",
    "rules_eval": _RULED + """
        SELECT event_id, CASE WHEN rule IS NULL THEN 'allow' ELSE 'block' END AS action, rule FROM ruled""",
    "rules_summary": _RULED + """
        SELECT rule, CASE WHEN rule IS NULL THEN 'allow' ELSE 'block' END AS action, count(*) AS hits
        FROM ruled GROUP BY rule""",
    "rules_text": """
        WITH judged AS (
          SELECT doc_id,
                 CASE WHEN lang IN ('de', 'es') THEN 'lang'
                      WHEN contains(lower(text), 'eaux') OR contains(lower(text), 'nikto') OR contains(lower(text), 'stre')
                        OR contains(lower(text), 'qu''') OR contains(lower(text), 'und der') THEN 'speech' END AS rule
          FROM documents)
        SELECT doc_id, CASE rule WHEN 'lang' THEN 'count' WHEN 'speech' THEN 'block' ELSE 'allow' END AS action, rule
        FROM judged""",
    "contains_any": """
        SELECT page_id, contains(lower(html), 'nmap') OR contains(lower(html), 'nicht') OR contains(lower(html), '<table') AS hit
        FROM pages""",
}
