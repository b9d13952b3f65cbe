"""Delivery requests as rows: classification, unnesting, duplicates, statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayline.functions import constants as K
from quayline.functions.names import is_delivery_path
from quayline.functions.rows import computed_once
from quayline.functions.text import trim_space


def undecodable(payloads: str = "payloads") -> Column:
    """True if any record of a request was not strict base64."""
    return F.exists(payloads, lambda p: p.isNull())


def classify_deliveries(df: DataFrame, expected_key: str | None = None) -> DataFrame:
    """Add the HTTP ``status`` and ``error`` each request would be answered with.

    Takes parsed requests with ``method, path, access_key, body``.  The first
    failing check decides: method, route, readable body, key, JSON, base64.  An
    empty expected key switches the key check off.  A request with one
    undecodable record fails as a whole and keeps none of its records.
    """
    wrong_key = F.lit(False)
    if expected_key:
        wrong_key = ~F.col("access_key").eqNullSafe(F.lit(expected_key))
    status = (
        F.when(~F.col("method").eqNullSafe(F.lit("POST")), 405)
        .when(~is_delivery_path("path"), 404)
        .when(F.col("body").isNull(), 400)
        .when(wrong_key, 403)
        .when(~F.col("valid_json"), 400)
        .when(undecodable(), 500)
        .otherwise(200)
    )
    error = F.when(F.col("body").isNull() & (F.col("status") == 400), K.UNREADABLE_BODY)
    for code, message in K.DELIVERY_ERRORS.items():
        error = error.when(F.col("status") == code, message)
    judged = computed_once(df, {"status": status})
    return judged.withColumn("error", error)


def payload_lines(payload: Column) -> Column:
    """The non-blank lines, trimmed, of one record."""
    lines = F.transform(F.split(trim_space(payload), "\n", -1), lambda line: trim_space(line))
    return F.filter(lines, lambda line: line != "")


def explode_records(df: DataFrame, keep: Sequence[str] = ("request_id",)) -> DataFrame:
    """One row per non-blank line: ``rec_pos`` and ``line_pos`` give the order."""
    records = df.select(*keep, F.posexplode("payloads").alias("rec_pos", "_payload"))
    return records.select(*keep, "rec_pos", F.posexplode(payload_lines(F.col("_payload"))).alias("line_pos", "line"))


def delivery_stats(df: DataFrame, keep: Sequence[str] = ("request_id",)) -> DataFrame:
    """Records in each request and rows they hold, without unnesting anything."""
    rows = F.aggregate(
        F.transform("payloads", lambda p: F.coalesce(F.array_size(payload_lines(p)), F.lit(0))), F.lit(0), lambda a, x: a + x
    )
    return df.select(
        *keep,
        F.array_size("payloads").cast("bigint").alias("records_in_batch"),
        rows.cast("bigint").alias("ingested"),
    )


def dedup_requests(
    df: DataFrame, order: Sequence[str | Column], keys: Sequence[str] = ("request_id",), keep_anonymous: bool = False
) -> DataFrame:
    """The first request of each key, by ``order``.

    Requests without an id share the empty key, so only the first of them stays;
    ``keep_anonymous`` keeps them all.  Spark applies the rank limit before the
    shuffle as well, so each map task sends at most one row per key and a key
    with very many copies costs no more than any other.
    """
    ordered = Window.partitionBy(*keys).orderBy(*order)
    if not keep_anonymous:
        return df.withColumn("_rank", F.row_number().over(ordered)).where("_rank = 1").drop("_rank")
    anonymous = F.coalesce(F.col(keys[-1]).cast("string"), F.lit("")) == ""
    named = dedup_requests(df.where(~anonymous), order, keys)
    return named.unionByName(df.where(anonymous))


def drop_seen(new: DataFrame, seen: DataFrame, keys: Sequence[str] = ("request_id",)) -> DataFrame:
    """Requests whose key is not among those already processed.

    No side is forced into memory: Spark broadcasts ``seen`` only when its
    statistics are under the session's threshold, and otherwise sorts and
    merges, splitting partitions that hold a hot key.
    """
    return new.join(seen.select(*keys), list(keys), "left_anti")
