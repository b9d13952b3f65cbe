"""Writing rows into many folders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayline.session import setting

OPEN_FILES = 4


def write_partitioned(
    df: DataFrame, root: str, fmt: str, targets: Sequence[str], folders: Sequence[str] | None = None, replace_all: bool = False, **options
) -> None:
    """Write rows to one folder per value of ``folders`` (default: ``targets``).

    Rows are brought together by ``targets`` first, so a small target gets one
    file; Spark splits a target that holds too many rows for one task.  Merging
    small partitions is switched off meanwhile: it would save no file and let one
    task write the files of many targets one after the other.  Adaptive execution
    is switched on, because a stream turns it off for its batches and Spark then
    ignores the rebalancing: each task would write a file for each target.

    A task keeps the files of its first ``OPEN_FILES`` targets open together, so the rows of
    a few big targets go straight to their files instead of being sorted by target, which
    held what the task read; only tasks with more targets sort, from there on.

    Folders that get rows are replaced, all others stay (``replace_all`` drops
    them too).
    """
    spark = df.sparkSession
    with (
        setting(spark, "spark.sql.adaptive.enabled", "true"),
        setting(spark, "spark.sql.adaptive.coalescePartitions.enabled", "false"),
        setting(spark, "spark.sql.maxConcurrentOutputFileWriters", str(OPEN_FILES)),
    ):
        # The hint is dropped right here unless adaptive execution is on.
        rows = df.hint("rebalance", *[F.col(c) for c in targets])
        writer = rows.write.mode("overwrite").options(**options).partitionBy(*(folders or targets))
        if not replace_all:
            writer = writer.option("partitionOverwriteMode", "dynamic")
        writer.format(fmt).save(root)
