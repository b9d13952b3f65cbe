"""Continuous file ingestion into tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from datetime import datetime
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quayline.functions import constants as K
from quayline.functions.text import instant
from quayline.operators.tables import DEFAULT_NAMESPACE, append_table, row_document
from quayline.sources.files import LAYOUTS, format_glob, json_lines, json_whole, named_as_lines
from quayline.sources.objects import file_key, load_keys

AVAILABLE_NOW = {"availableNow": True}


def buffer_trigger(size_mb: int = K.BUFFER_MB[2], seconds: int = K.BUFFER_SECONDS[2]) -> tuple[int, dict[str, str]]:
    """Buffer bounds as a size cap per batch and a trigger interval.

    A batch starts every ``seconds`` and takes files up to ``size_mb``.
    """
    for value, (low, high, _), name in ((size_mb, K.BUFFER_MB, "size_mb"), (seconds, K.BUFFER_SECONDS, "seconds")):
        if not low <= value <= high:
            raise ValueError(f"{name} must be between {low} and {high}")
    return size_mb * 1024 * 1024, {"processingTime": f"{seconds} seconds"}


def stream_objects(
    spark: SparkSession,
    root: str,
    fmt: str,
    prefix: str | None = None,
    pattern: str | None = None,
    internal_prefixes: Iterable[str] = (),
    since: datetime | None = None,
    max_bytes: int | None = None,
    schema: str | None = None,
    layout: str = "auto",
) -> DataFrame:
    """Rows of new files as a stream of ``key, doc``.

    The checkpoint remembers which files were taken.  ``since`` leaves out files
    that were there before, by modification time.  All predicates are on file
    metadata, so files that do not match are never opened.  JSON files named
    ``.jsonl``/``.ndjson`` are read as lines, others file by file; ``layout`` as
    ``lines`` or ``whole`` reads all one way and lists the store once per batch
    instead of twice.  Parquet needs a schema, as in every file stream.
    """
    if layout not in LAYOUTS:
        raise ValueError(f"layout must be one of {LAYOUTS}")
    read = spark.readStream.option("recursiveFileLookup", True)
    if fmt in K.FORMAT_EXTENSIONS:
        read = read.option("pathGlobFilter", format_glob(fmt))
    if max_bytes:
        read = read.option("maxBytesPerTrigger", max_bytes)

    def load(reader: Callable[[str], DataFrame]) -> DataFrame:
        rows = load_keys(reader, root, lambda: file_key(root), prefix, pattern, internal_prefixes)
        if since is not None:
            rows = rows.where(F.col("_metadata.file_modification_time") >= instant(since))
        return rows

    if fmt == "csv":
        return load(read.options(header=True, escape='"', singleVariantColumn="doc").csv).select("key", "doc")
    if fmt == "parquet":
        rows = load(read.schema(schema).parquet)
        return rows.select("key", row_document([c for c in rows.columns if c != "key"]).alias("doc"))
    lines = load(read.text).withColumnRenamed("value", "line")
    whole = load(partial(read.text, wholetext=True)).withColumnRenamed("value", "body")
    if layout == "lines":
        return json_lines(lines)
    if layout == "whole":
        return json_whole(whole)
    return json_lines(lines.where(named_as_lines())).unionByName(json_whole(whole.where(~named_as_lines())))


def load_name(batch: DataFrame, name: str, number: int) -> str:
    """The name of a micro-batch's load: that of the query, whose id its checkpoint
    keeps, and the batch's number.  A repeated batch has the same name; two queries,
    or one that starts again from an empty checkpoint, never share one."""
    query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
    if not query:
        raise RuntimeError("a load is named within a streaming query only")
    return f"{name}-{query}-{number}"


def ingest_stream(
    rows: DataFrame,
    table_root: str,
    table: str,
    checkpoint: str,
    name: str = "objects",
    namespace: tuple[str, str] = DEFAULT_NAMESPACE,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Append a stream of ``key, doc`` to a table.

    Each micro-batch is one load named after the query and its number: a batch that
    is repeated after a failure replaces itself, so every row arrives once, and
    streams into one table leave each other's loads alone.
    """

    def write(batch: DataFrame, number: int) -> None:
        append_table(batch, table_root, table, load_name(batch, name, number), namespace, origin=F.col("key"))

    return (
        rows.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or AVAILABLE_NOW))
        .start()
    )


def drain(query: StreamingQuery, timeout: int = 600) -> None:
    """Wait until an available-now query is done; its failure is raised here."""
    if not query.awaitTermination(timeout):
        query.stop()
        raise TimeoutError(f"stream still running after {timeout} s")
