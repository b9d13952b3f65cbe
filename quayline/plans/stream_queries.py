"""Queries that run a stream to its end and return what it left behind."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayline.functions.documents import typed_columns
from quayline.operators.backups import replay_backup
from quayline.operators.tables import read_table, table_counts
from quayline.plans.file_queries import EVENT_FIELDS, EVENT_TYPES
from quayline.plans.inputs import CHANGE_SCHEMA, changes, requests, staged_json, staged_parquet, table
from quayline.session import run_folder
from quayline.sources.changes import cdc_changes, pipeline_checkpoint
from quayline.streaming.changes import cdc_stream
from quayline.streaming.deliveries import ENVELOPE, dedup_stream, delivery_stream
from quayline.streaming.ingest import drain, ingest_stream, stream_objects
from quayline.streaming.rates import end_marker, rate_exceeded_stream
from quayline.streaming.versions import Store, merge_changes, read_current

ENVELOPE_SCHEMA = (
    "method string, path string, access_key string, header_request_id string, body string, arrived timestamp"
)


def stream_ingest(spark, sf_dir):
    """Files of two folders, taken in batches of limited size, into one table."""
    rows = table(spark, sf_dir, "events").select(*EVENT_FIELDS).withColumn("kind", F.col("event_type"))
    folder = staged_json(spark, rows.repartition(4, "event_id"), "stream", ("kind",), compression="gzip")
    root = run_folder(spark, "lake")
    files = stream_objects(spark, folder, "json", pattern="^kind=(click|view)/", max_bytes=262144)
    drain(ingest_stream(files, root, "events", run_folder(spark, "checkpoint")))
    return read_table(spark, root, "events", EVENT_TYPES)


def stream_resume(spark, sf_dir):
    """The same checkpoint run three times, with more files in between."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    folder, root, checkpoint = (run_folder(spark, name) for name in ("resume", "lake", "checkpoint"))
    pipeline = pipeline_checkpoint(checkpoint, 12)

    def run():
        files = stream_objects(spark, folder, "csv")
        drain(ingest_stream(files, root, "orders", pipeline))

    urgent = F.col("o_orderpriority") == "1-URGENT"
    for part in (rows.where(urgent), rows.where(~urgent)):
        part.write.mode("append").option("header", True).csv(folder)
        run()
    run()
    schema = "o_orderkey bigint, o_orderstatus string, o_orderpriority string"
    return read_table(spark, root, "orders", schema)


def stream_shared(spark, sf_dir):
    """Two streams into one table, one of them started again from an empty checkpoint
    when its files were replaced by others, and one run again without new files."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    root = run_folder(spark, "lake")
    for status, checkpoints in (("F", 1), ("O", 1), ("P", 2)):
        some = rows.where(F.col("o_orderstatus") == status)
        for k in range(checkpoints):
            half = some.where(F.pmod("o_orderkey", F.lit(checkpoints)) == k)
            folder, checkpoint = staged_json(spark, half, f"shared-{status}"), run_folder(spark, "checkpoint")
            for _ in range(2):
                drain(ingest_stream(stream_objects(spark, folder, "json", layout="lines"), root, "orders", checkpoint))
    schema = "o_orderkey bigint, o_orderstatus string, o_orderpriority string"
    return read_table(spark, root, "orders", schema)


def stream_dedup(spark, sf_dir):
    """Order lines as deliveries of their order: one stays per order."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_shipdate").cast("timestamp").alias("at"))
    folder = staged_parquet(spark, lines, "dedup")
    stream = spark.readStream.schema(lines.schema).parquet(folder)
    out = run_folder(spark, "deduped")
    query = (
        dedup_stream(stream, ["l_orderkey"])
        .writeStream.option("checkpointLocation", run_folder(spark, "checkpoint"))
        .trigger(availableNow=True)
        .format("parquet")
        .start(out)
    )
    drain(query)
    return spark.read.schema(lines.schema).parquet(out).select("l_orderkey")


def _deliver(spark, sf_dir):
    folder = staged_json(spark, requests(spark, sf_dir).select(*ENVELOPE), "requests")
    stream = spark.readStream.schema(ENVELOPE_SCHEMA).json(folder)
    root, backup = run_folder(spark, "lake"), run_folder(spark, "backup")
    drain(delivery_stream(stream, root, backup, run_folder(spark, "checkpoint"), expected_key="right-key"))
    return root, backup


def stream_delivery(spark, sf_dir):
    root, _ = _deliver(spark, sf_dir)
    return table_counts(spark, root)


def stream_backup(spark, sf_dir):
    _, backup = _deliver(spark, sf_dir)
    rows = replay_backup(spark, backup, ENVELOPE_SCHEMA + ", status bigint, error string")
    return rows.groupBy("status", "error").agg(F.count("*").alias("requests"))


def stream_cdc(spark, sf_dir):
    rows = changes(spark, sf_dir)
    folder = staged_json(spark, rows.repartitionByRange(4, "lsn"), "changes")
    log, current = run_folder(spark, "log"), run_folder(spark, "current")
    stream = cdc_changes(spark, folder, CHANGE_SCHEMA, max_bytes=262144)
    drain(cdc_stream(stream, log, current, ["user_id"], run_folder(spark, "checkpoint"), buckets=4))
    state = read_current(spark, current, T.StructType.fromDDL(CHANGE_SCHEMA))
    return state.select("user_id", "lsn", "op", F.col("after.props").alias("props"))


def cdc_versions(spark, sf_dir):
    """A change log in four commits: current rows after the second and after the last."""
    log = changes(spark, sf_dir)
    last = log.agg(F.max("lsn").alias("last")).first()["last"] + 1
    root = run_folder(spark, "versions")
    for quarter in range(4):
        merge_changes(log.where(F.expr(f"lsn * 4 div {last} = {quarter}")), root, ["user_id"], 8, "log", quarter)
        if quarter == 1:
            at_half = Store(spark, root).versions()[-1]
    schema = T.StructType.fromDDL(CHANGE_SCHEMA)
    states = [read_current(spark, root, schema, version=v).withColumn("quarters", F.lit(q)) for q, v in ((2, at_half), (4, None))]
    return states[0].unionByName(states[1]).select("quarters", "user_id", "lsn", F.col("after.props").alias("props"))


def stream_cdc_log(spark, sf_dir):
    folder = staged_json(spark, changes(spark, sf_dir), "changes")
    log, current = run_folder(spark, "log"), run_folder(spark, "current")
    stream = cdc_changes(spark, folder, CHANGE_SCHEMA)
    drain(cdc_stream(stream, log, current, ["user_id"], run_folder(spark, "checkpoint"), buckets=4))
    rows = read_table(spark, log, "public_user__state")
    return rows.select("origin", *typed_columns("doc", "user_id string, props string"))


def stream_rate(spark, sf_dir):
    """Users with more than 5 events in a day, looked at every 12 hours; a
    marker behind the last event closes the last windows."""
    rows = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("at"))
    folder = staged_parquet(spark, rows, "rate")
    end_marker(rows, "at", "1 day", "1 hour").write.mode("append").parquet(folder)
    stream = spark.readStream.schema(rows.schema).parquet(folder)
    out = run_folder(spark, "rates")
    over = rate_exceeded_stream(stream, "user_id", "at", 5, "1 day", "12 hours", "1 hour")
    query = (
        over.writeStream.option("checkpointLocation", run_folder(spark, "checkpoint"))
        .trigger(availableNow=True)
        .format("parquet")
        .start(out)
    )
    drain(query)
    found = spark.read.schema(over.schema).parquet(out)
    return found.select("user_id", "requests", *[F.col(f"window_{e}").cast("timestamp_ntz").alias(f"window_{e}") for e in ("start", "end")])


QUERIES = {
    "stream_ingest": stream_ingest,
    "stream_resume": stream_resume,
    "stream_shared": stream_shared,
    "stream_dedup": stream_dedup,
    "stream_delivery": stream_delivery,
    "stream_backup": stream_backup,
    "stream_cdc": stream_cdc,
    "cdc_versions": cdc_versions,
    "stream_cdc_log": stream_cdc_log,
    "stream_rate": stream_rate,
}

ORACLES = {
    "cdc_versions": """
        WITH cut AS (SELECT q AS quarters, e.* FROM events e, (VALUES (2), (4)) v(q)
                     WHERE event_id * 4 // (SELECT max(event_id) + 1 FROM events) < q),
        r AS (SELECT *, row_number() OVER (PARTITION BY quarters, user_id ORDER BY event_id DESC) AS n FROM cut)
        SELECT quarters, user_id, event_id AS lsn, props FROM r WHERE n = 1 AND event_type <> 'error'""",
    "stream_ingest": """
        SELECT event_id, user_id, event_type, value, props FROM events WHERE event_type IN ('click', 'view')""",
    "stream_resume": "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders",
    "stream_shared": "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders",
    "stream_dedup": "SELECT DISTINCT l_orderkey FROM lineitem",
    "stream_rate": """
        WITH w AS (
          SELECT user_id, time_bucket(INTERVAL 12 HOURS, ts, TIMESTAMP '1970-01-01') - n * INTERVAL 12 HOURS AS window_start
          FROM events, (VALUES (0), (1)) v(n)),
        c AS (SELECT user_id, window_start, count(*) AS requests FROM w GROUP BY ALL)
        SELECT user_id, requests, window_start, window_start + INTERVAL 1 DAY AS window_end FROM c
        WHERE requests > 5""",
}
