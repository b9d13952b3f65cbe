"""Backfill of a table from an object store, and the proof that it arrived."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayline.operators.filters import filter_objects
from quayline.operators.outcomes import file_results
from quayline.operators.tables import DEFAULT_NAMESPACE, append_table, read_table
from quayline.sources.files import read_objects
from quayline.sources.objects import object_catalog


def backfill(
    spark: SparkSession,
    root: str,
    table_root: str,
    table: str,
    fmt: str,
    load_id: str,
    prefix: str | None = None,
    pattern: str | None = None,
    internal_prefixes: Iterable[str] = (),
    layout: str = "auto",
    namespace: tuple[str, str] = DEFAULT_NAMESPACE,
) -> DataFrame:
    """Load every matching file into a table; returns one result per file.

    The rows are written first; the results are then counted from what the table
    holds of this load, so they prove arrival.  A file is ok if all its rows are
    documents; text that is no JSON is kept and makes its file not ok.
    """
    keys = {"fmt": fmt, "prefix": prefix, "pattern": pattern, "internal_prefixes": tuple(internal_prefixes)}
    rows = read_objects(spark, root, layout=layout, **keys)
    append_table(rows, table_root, table, load_id, namespace, origin=F.col("key"))
    written = read_table(spark, table_root, table, namespace=namespace).where(F.col("load_id") == load_id)
    unparsed = F.schema_of_variant("doc") == "STRING"
    listed = filter_objects(object_catalog(spark, root, prefix), "key", **keys)
    return file_results(written.select(F.col("origin").alias("key"), "doc"), unparsed, listed)
