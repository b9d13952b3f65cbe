"""Backup of failed (or all) rows, its replay and its retention."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayline.functions import constants as K
from quayline.functions.text import instant
from quayline.operators.writes import write_partitioned

MICROS_FORMAT = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}
HOUR_PARTS = {"y": "yyyy", "m": "MM", "d": "dd", "h": "HH"}


def with_backup(
    df: DataFrame, failed: Column | str, mode: str = K.BACKUP_FAILED_ONLY
) -> tuple[DataFrame, DataFrame]:
    """Split into rows to keep and rows to back up.

    The backup holds the failed rows, or every row in ``AllData`` mode.  Any
    other mode name acts like ``FailedDataOnly``; an unknown outcome is a failure.
    """
    bad = F.coalesce(F.expr(failed) if isinstance(failed, str) else failed, F.lit(True))
    return df.where(~bad), df if mode == K.BACKUP_ALL else df.where(bad)


def write_backup(df: DataFrame, root: str, ts: str, load_id: str) -> None:
    """Write rows as gzip JSON lines under ``y=/m=/d=/h=`` of their time (UTC).

    Writing the same load again replaces it.  Rows are rebalanced by hour, so a
    quiet hour gets one file and a busy one is split over tasks.
    """
    when = F.col(ts)
    hours = {name: F.coalesce(F.date_format(when, fmt), F.lit("unknown")) for name, fmt in HOUR_PARTS.items()}
    rows = df.withColumns({**hours, "load_id": F.lit(load_id)})
    parts = list(HOUR_PARTS)
    write_partitioned(rows, root, "json", parts, [*parts, "load_id"], compression="gzip", **MICROS_FORMAT)


def _hour() -> Column:
    return F.concat_ws("-", *HOUR_PARTS)


def _hour_of(ts: datetime) -> Column:
    return F.date_format(instant(ts), "yyyy-MM-dd-HH")


def replay_backup(
    spark: SparkSession,
    root: str,
    schema: T.StructType | str,
    ts: str | None = None,
    since: datetime | None = None,
    until: datetime | None = None,
) -> DataFrame:
    """Backed-up rows of ``since <= ts < until``.

    The bounds prune hour directories; with ``ts`` they also hold row by row.
    """
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    parts = T.StructType([T.StructField(p, T.StringType()) for p in (*HOUR_PARTS, "load_id")])
    rows = spark.read.schema(T.StructType(fields.fields + parts.fields)).options(**MICROS_FORMAT).json(root)
    if since is not None:
        rows = rows.where(_hour() >= _hour_of(since))
        rows = rows.where(F.col(ts) >= instant(since)) if ts else rows
    if until is not None:
        rows = rows.where(_hour() <= _hour_of(until))
        rows = rows.where(F.col(ts) < instant(until)) if ts else rows
    return rows.drop(*HOUR_PARTS, "load_id")


def first_kept_day(now: datetime, days: int = K.BACKUP_RETENTION_DAYS) -> str:
    return (now - timedelta(days=days)).strftime("%Y-%m-%d")


def live_backup(df: DataFrame, ts: str, now: datetime, days: int = K.BACKUP_RETENTION_DAYS) -> DataFrame:
    """Rows whose day has not expired yet."""
    return df.where(F.col(ts) >= F.lit(first_kept_day(now, days)).cast("timestamp_ntz"))


def expire_backup(spark: SparkSession, root: str, now: datetime, days: int = K.BACKUP_RETENTION_DAYS) -> int:
    """Delete the day folders before the retention limit; returns how many.

    Works on folder names through the cluster's file system and reads no data.
    """
    limit = first_kept_day(now, days)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    base = hadoop.Path(root)
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    expired = 0
    for status in fs.globStatus(hadoop.Path(base, "y=*/m=*/d=*")) or []:
        path = status.getPath()
        day, month, year = path.getName(), path.getParent().getName(), path.getParent().getParent().getName()
        if "-".join(part.split("=", 1)[1] for part in (year, month, day)) < limit:
            expired += bool(fs.delete(path, True))
    return expired
