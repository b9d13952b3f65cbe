"""Row filters over object keys and object events."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayline.functions import constants as K
from quayline.functions import text


def filter_prefix(df: DataFrame, key_col: str, prefix: str | None) -> DataFrame:
    """Literal, case-sensitive prefix; an empty prefix keeps every row."""
    return df.where(text.matches_prefix(key_col, prefix)) if prefix else df


def filter_format(df: DataFrame, key_col: str, fmt: str | None) -> DataFrame:
    """Keys with a suffix of the format, upper or lower case."""
    return df.where(text.matches_format(key_col, fmt)) if K.FORMAT_EXTENSIONS.get(fmt or "") else df


def filter_pattern(df: DataFrame, key_col: str, pattern: str | None) -> DataFrame:
    """Keys in which the Java regular expression is found anywhere."""
    return df.where(text.matches_pattern(key_col, pattern)) if pattern else df


def filter_internal(df: DataFrame, key_col: str, prefixes: Iterable[str] = ()) -> DataFrame:
    """Drop keys the ingestion tooling wrote for itself."""
    prefixes = tuple(prefixes)
    return df.where(text.outside_prefixes(key_col, prefixes)) if prefixes else df


def filter_objects(
    df: DataFrame,
    key_col: str,
    fmt: str | None = None,
    prefix: str | None = None,
    pattern: str | None = None,
    internal_prefixes: Iterable[str] = (),
) -> DataFrame:
    """All key filters; the cheap ones come first."""
    df = filter_internal(filter_prefix(df, key_col, prefix), key_col, internal_prefixes)
    return filter_pattern(filter_format(df, key_col, fmt), key_col, pattern)


def is_valid_event(bucket: str = "bucket", key: str = "key") -> Column:
    return (F.coalesce(F.col(bucket), F.lit("")) != "") & (F.coalesce(F.col(key), F.lit("")) != "")


def valid_events(df: DataFrame) -> DataFrame:
    """Events that name both a bucket and a key."""
    return df.where(is_valid_event())


def match_events(
    df: DataFrame,
    sources: Iterable[str] = K.OBJECT_EVENT_SOURCES,
    detail_types: Iterable[str] = K.OBJECT_EVENT_DETAIL_TYPES,
    buckets: Iterable[str] | None = None,
    key_prefix: str | None = None,
    key_col: str = "raw_key",
) -> DataFrame:
    """Events whose source, type and bucket are listed and whose key, as sent
    (still encoded), starts with the prefix."""
    wanted = F.col("source").isin(list(sources)) & F.col("detail_type").isin(list(detail_types))
    if buckets is not None:
        wanted &= F.col("bucket").isin(list(buckets))
    return filter_prefix(df.where(wanted), key_col, key_prefix)


def classify_events(
    df: DataFrame,
    prefix: str | None = None,
    fmt: str | None = None,
    pattern: str | None = None,
    internal_prefixes: Iterable[str] = (),
) -> DataFrame:
    """Add ``status`` (``ingested`` or ``skipped``) and the ``reason`` of a skip.

    The first failing check wins.  Keys under an internal prefix count as prefix
    mismatches, so both the listing and the event path leave them alone.
    """
    in_prefix = text.matches_prefix("key", prefix) & text.outside_prefixes("key", internal_prefixes)
    reason = (
        F.when(~is_valid_event(), K.INVALID_EVENT)
        .when(~in_prefix, K.PREFIX_MISMATCH)
        .when(~text.matches_format("key", fmt), K.FORMAT_MISMATCH)
        .when(~text.matches_pattern("key", pattern), K.PATTERN_MISMATCH)
    )
    return df.withColumn("reason", reason).withColumn(
        "status", F.when(F.col("reason").isNull(), "ingested").otherwise("skipped")
    )


def event_summary(classified: DataFrame) -> DataFrame:
    """Events per status and reason."""
    return classified.groupBy("status", "reason").agg(F.count("*").alias("events"))
