"""Per-row defaults and effective-dated routes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayline.functions.text import first_non_empty
from quayline.operators.running import last_so_far, micros


def apply_defaults(df: DataFrame, defaults: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Fill columns that are NULL or empty from the defaults of the same key.

    An equi-join without a hint: small defaults are broadcast by their size.
    """
    d = defaults.select(*keys, *[F.col(c).alias(f"_default_{c}") for c in columns])
    joined = df.join(d, list(keys), "left")
    return joined.select(
        *[
            first_non_empty(c, f"_default_{c}").alias(c) if c in columns else F.col(c)
            for c in df.columns
        ]
    )


def effective_ranges(routes: DataFrame, source: str, since: str = "valid_from") -> DataFrame:
    """Add ``valid_to``: the start of the next route of the same source.

    Configuration history: a source has as many rows as it was retargeted.
    """
    grouped = Window.partitionBy(source).orderBy(since)
    return routes.withColumn("valid_to", F.lead(since).over(grouped))


def _moment(df: DataFrame, column: str) -> Column:
    """A time as a number; numbers stay what they are."""
    return F.col(column).cast("long") if isinstance(df.schema[column].dataType, T.NumericType) else micros(column)


def route_as_of(
    records: DataFrame,
    routes: DataFrame,
    source: str,
    ts: str,
    since: str = "valid_from",
    until: str = "valid_to",
    slices: int | None = None,
) -> DataFrame:
    """Add the columns of the route that was valid when a record arrived.

    ``since <= ts < until``; an open end is NULL; records no route covers, and records
    without source or time, keep NULLs.  Ranges of one source must not overlap, as those
    of ``effective_ranges`` don't.  Records and routes of a source are put in order of
    time once and each record takes the last route so far: no record meets another
    route, however many its source has, and a hot source is cut into slices of time.
    Finding hot sources takes a pass over the two key columns.
    """
    added = [c for c in routes.columns if c not in (source, since, until)]
    route = F.struct(_moment(routes, until).alias("until"), *[F.col(f"`{c}`") for c in added])
    record = F.struct(*[F.col(f"`{c}`") for c in records.columns])
    # Of routes that begin together the one that ends last is the one that covers anything.
    ends = F.coalesce(_moment(routes, until), F.lit((1 << 63) - 1))
    begun = routes.where(F.col(source).isNotNull() & F.col(since).isNotNull()).select(
        F.col(source).alias("_source"), _moment(routes, since).alias("_at"), F.lit(0).alias("_kind"), ends.alias("_end"), route.alias("_route")
    )
    asking = records.select(
        F.col(source).alias("_source"), _moment(records, ts).alias("_at"), F.lit(1).alias("_kind"), F.lit(0).cast("long").alias("_end"), record.alias("_record")
    )
    both = begun.unionByName(asking, allowMissingColumns=True)
    found = last_so_far(both, ["_source"], "_at", "_route", "_found", ["_kind", "_end"], slices).where("_kind = 1")
    covered = F.col("_source").isNotNull() & F.col("_at").isNotNull() & (F.col("_found.until").isNull() | (F.col("_at") < F.col("_found.until")))
    return found.select("_record.*", *[F.when(covered, F.col("_found")[c]).alias(c) for c in added])
