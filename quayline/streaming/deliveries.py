"""Streams of delivery requests: duplicates, unnesting, routing, dead letters."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quayline.functions import constants as K
from quayline.functions.documents import document
from quayline.operators.backups import with_backup, write_backup
from quayline.operators.deliveries import classify_deliveries, explode_records
from quayline.operators.tables import write_routed
from quayline.sources.events import delivery_requests, route
from quayline.streaming.ingest import AVAILABLE_NOW, load_name

ENVELOPE = ("method", "path", "access_key", "header_request_id", "body", "arrived")


def dedup_stream(
    rows: DataFrame, keys: Sequence[str] = ("request_id",), arrived: str | None = None, horizon: str | None = None
) -> DataFrame:
    """Drop repeated keys from a stream.

    Without a horizon every key is remembered for ever.  With ``arrived`` and
    ``horizon`` (such as ``"1 day"``) keys are forgotten once the stream has moved
    on that far, so a copy that comes later than that is taken as new.

    The copies of one key in one micro-batch pass through one task, row by row;
    the size cap of the batch bounds them.
    """
    if (arrived is None) != (horizon is None):
        raise ValueError("arrived and horizon go together")
    if horizon is None:
        return rows.dropDuplicates(list(keys))
    return rows.withWatermark(arrived, horizon).dropDuplicatesWithinWatermark(list(keys))


class SideBySide:
    """Queries that run together: waiting and stopping mean all of them."""

    def __init__(self, *queries: StreamingQuery):
        self.queries = queries

    def awaitTermination(self, timeout: int | None = None) -> bool | None:  # noqa: N802  as Spark's queries name it
        end = None if timeout is None else time.monotonic() + timeout
        try:
            done = [q.awaitTermination(*([] if end is None else [max(1, int(end - time.monotonic()))])) for q in self.queries]
        except Exception:
            self.stop()
            raise
        return None if end is None else all(done)

    def stop(self) -> None:
        for q in self.queries:
            q.stop()


def classified_requests(requests: DataFrame, expected_key: str | None = None) -> DataFrame:
    """Envelope rows -> parsed, routed requests with their answer status.

    ``dedup_key`` is the request id of an accepted request; a rejected one does
    not use its id up, so it is keyed by all it contains.  A stream remembers keys of
    accepted requests only.
    """
    parsed = route(delivery_requests(requests, "body", "header_request_id"))
    judged = classify_deliveries(parsed, expected_key)
    whole = F.sha2(F.to_json(F.struct(*[F.col(c) for c in ENVELOPE])), 256)
    accepted = F.col("status") == 200
    return judged.withColumn(
        "dedup_key",
        F.when(accepted, F.concat(F.lit("id:"), F.col("request_id"))).otherwise(F.concat(F.lit("rejected:"), whole)),
    )


def delivered_rows(requests: DataFrame) -> DataFrame:
    """Accepted requests -> table rows ready for routing; a line that is no JSON
    is stored as a text document."""
    accepted = requests.where(F.col("status") == 200)
    lines = explode_records(accepted, keep=("request_id", "org", "project", "table"))
    return lines.select(
        document("line").alias("doc"), F.col("request_id").alias("origin"), "org", "project", "table"
    )


def delivery_stream(
    requests: DataFrame,
    table_root: str,
    backup_root: str,
    checkpoint: str,
    expected_key: str | None = None,
    backup_mode: str = K.BACKUP_FAILED_ONLY,
    horizon: str | None = None,
    name: str = "deliveries",
    trigger: dict | None = None,
) -> SideBySide:
    """Deliver a stream of request envelopes into tables.

    One query per micro-batch classifies, drops repeated requests, unnests, routes and
    appends.  Another one writes the rejected requests (or all, by mode), repeated ones
    too, to the backup, from which they can be replayed; it has a checkpoint of its
    own beside the first, so a table that can't be written doesn't keep requests out of
    the backup.  Lost tasks are run again by Spark, and a repeated batch replaces its
    own load; what still fails after that stops the query at its checkpoint.
    """
    judged = classified_requests(requests, expected_key)
    accepted = dedup_stream(
        judged.where(F.col("status") == 200), ["dedup_key"], "arrived" if horizon else None, horizon
    )

    def deliver(batch: DataFrame, number: int) -> None:
        write_routed(delivered_rows(batch), table_root, load_name(batch, name, number))

    def keep(batch: DataFrame, number: int) -> None:
        _, backup = with_backup(batch, F.col("status") != 200, backup_mode)
        write_backup(backup.select(*ENVELOPE, "status", "error"), backup_root, "arrived", load_name(batch, name, number))

    def start(rows: DataFrame, write: Callable[[DataFrame, int], None], folder: str) -> StreamingQuery:
        query = rows.writeStream.foreachBatch(write).option("checkpointLocation", folder)
        return query.trigger(**(trigger or AVAILABLE_NOW)).start()

    return SideBySide(start(accepted, deliver, checkpoint), start(judged, keep, f"{checkpoint.rstrip('/')}-backup"))
