"""Replication of change rows: an append log and a table of current rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quayline.operators.changes import change_rows
from quayline.operators.tables import write_routed
from quayline.streaming.ingest import AVAILABLE_NOW, load_name
from quayline.streaming.versions import merge_changes

def cdc_stream(
    changes: DataFrame,
    log_root: str,
    current_root: str | None,
    keys: Sequence[str],
    checkpoint: str,
    buckets: int = 64,
    name: str = "changes",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Append a change stream to the log tables and keep the current rows.

    A batch writes its own changes only, as one new version of the current table
    (see ``versions``); a driver that is lost at any time leaves the version before.
    Choose ``buckets`` so that one holds a few hundred MB of current rows; the
    number belongs to the table.  Without a ``current_root`` only the log is
    written; current rows can be taken from a log at any time.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            load = load_name(batch, name, number)
            write_routed(change_rows(batch), log_root, load)
            if current_root is not None:
                merge_changes(batch, current_root, keys, buckets, load.rsplit("-", 1)[0], number)
        finally:
            batch.unpersist()

    return (
        changes.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or AVAILABLE_NOW))
        .start()
    )
