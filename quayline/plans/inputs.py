"""Inputs of the registered queries, derived by Spark from the given tables.

Each derived input keeps every row of its table, so its size grows with it.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quayline.session import run_folder, tune


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def staged_json(spark: SparkSession, rows: DataFrame, name: str, partition_by: tuple[str, ...] = (), **options) -> str:
    folder = run_folder(spark, name)
    rows.write.options(**options).partitionBy(*partition_by).json(folder)
    return folder


def staged_csv(spark: SparkSession, rows: DataFrame, name: str, partition_by: tuple[str, ...] = (), **options) -> str:
    folder = run_folder(spark, name)
    rows.write.options(header=True, **options).partitionBy(*partition_by).csv(folder)
    return folder


def staged_parquet(spark: SparkSession, rows: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> str:
    folder = run_folder(spark, name)
    rows.write.partitionBy(*partition_by).parquet(folder)
    return folder


def staged_arrays(spark: SparkSession, rows: DataFrame, name: str) -> str:
    """Write each partition as one file that holds one JSON array over many
    lines.  The rows stream through the task batch by batch."""
    folder = run_folder(spark, name)

    def brackets(batches):
        lead = "["
        for batch in batches:
            texts = batch["value"].copy()
            if len(texts):
                texts.iloc[0] = lead + texts.iloc[0]
                texts.iloc[1:] = "," + texts.iloc[1:]
                lead = ","
                yield texts.to_frame()
        # A partition without rows may come without any batch.
        yield pd.DataFrame({"value": ["]" if lead == "," else "[]"]})

    lines = rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))
    lines.mapInPandas(brackets, "value string").write.text(folder)
    return folder


# ---- object notifications from documents

NOTIFICATION_KEY = """concat(source, '/doc+', doc_id, '%20', n_chars,
  CASE WHEN n_chars < 1000 THEN '.JSON' WHEN n_chars < 2000 THEN '.jsonl.gz'
       WHEN n_chars < 4000 THEN '.csv' ELSE '.txt' END)"""


def notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One notification per document: ``doc_id, body``.  Spanish ones name no
    bucket, those of source ``src1`` have no detail at all."""
    docs = table(spark, sf_dir, "documents")
    bucket = F.struct(F.when(F.col("lang") != "es", F.col("lang")).alias("name"))
    detail = F.struct(bucket.alias("bucket"), F.struct(F.expr(NOTIFICATION_KEY).alias("key")).alias("object"))
    kind = F.when(F.col("lang") == "de", "Object Deleted").otherwise("Object Created")
    event = F.struct(
        F.lit("aws.s3").alias("source"),
        kind.alias("detail-type"),
        F.when(F.col("source") != "src1", detail).alias("detail"),
    )
    return docs.select("doc_id", F.to_json(event).alias("body"))


# ---- delivery requests from events

# Scala-style text of one event as JSON; doubles are left out on purpose, their
# text differs between engines.
EVENT_DOCUMENT = """concat('{"event_id":', event_id, ',"user_id":', user_id, ',"event_type":"', event_type, '"}')"""
ARRIVAL_MS = "unix_millis(cast(ts as timestamp))"


def _base64(text: Column) -> Column:
    return F.base64(F.encode(text, "UTF-8"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One delivery request per event, as it comes over the wire.

    A request has two records; the first holds two documents with blank lines and
    blanks around them, the second one line that is no document.  Signups carry
    no request id at all, clicks carry theirs in the header.  Some are wrong:
    views below 5 use GET, signups above 100 lack the transform, values above 150
    come with a wrong key, purchases above 100 are cut off and errors above 100
    are no base64.
    """
    events = table(spark, sf_dir, "events")
    first = F.concat(F.lit("\n  "), F.expr(EVENT_DOCUMENT), F.lit("\t\n\n \r\n"), F.col("props"), F.lit(" \n"))
    data = F.when((F.col("event_type") == "error") & (F.col("value") > 100), F.concat(F.lit("#"), _base64(first)))
    records = F.array(
        F.struct(data.otherwise(_base64(first)).alias("data")), F.struct(_base64(F.col("event_type")).alias("data"))
    )
    own_id = F.concat(F.lit("r-"), F.col("event_id"))
    in_body = F.when(F.col("event_type").isin("signup", "click"), "").otherwise(own_id)
    body = F.to_json(F.struct(in_body.alias("requestId"), F.expr(ARRIVAL_MS).alias("timestamp"), records.alias("records")))
    cut = (F.col("event_type") == "purchase") & (F.col("value") > 100)
    no_transform = (F.col("event_type") == "signup") & (F.col("value") > 100)
    path = F.concat(F.lit("/v1/acme/web/tables/"), F.col("event_type"))
    return events.select(
        "event_id",
        "event_type",
        "value",
        F.when((F.col("event_type") == "view") & (F.col("value") < 5), "GET").otherwise("POST").alias("method"),
        F.concat(path, F.when(no_transform, "").otherwise("?transform=firehose&columns=a,b")).alias("path"),
        F.when(F.col("value") > 150, "wrong-key").otherwise("right-key").alias("access_key"),
        F.when(F.col("event_type") == "click", own_id).alias("header_request_id"),
        F.when(cut, F.left(body, F.length(body) - 2)).otherwise(body).alias("body"),
        F.col("ts").cast("timestamp").alias("arrived"),
    )


# ---- change rows from events

CHANGE_SCHEMA = (
    "op string, lsn bigint, schema string, table string, user_id bigint, "
    "before struct<user_id: bigint, event_type: string, props: string>, "
    "after struct<user_id: bigint, event_type: string, props: string>"
)


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a change log of one row per user: an error event deletes it."""
    events = table(spark, sf_dir, "events")
    image = F.struct("user_id", "event_type", "props")
    deleted = F.col("event_type") == "error"
    return events.select(
        F.when(deleted, "D").when(F.col("event_type") == "signup", "I").otherwise("U").alias("op"),
        F.col("event_id").alias("lsn"),
        F.lit("public").alias("schema"),
        F.lit("user_state").alias("table"),
        "user_id",
        F.when(deleted, image).alias("before"),
        F.when(~deleted, image).alias("after"),
    )
