"""Initial copies and change streams of database tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def range_predicates(column: str, bounds: Sequence[int]) -> list[str]:
    """Disjoint SQL conditions that cover every key, NULL included: one per range
    between the bounds and one at each end."""
    bounds = sorted(set(bounds))
    if not bounds:
        return ["1 = 1"]
    inner = [f"{column} >= {a} AND {column} < {b}" for a, b in zip(bounds, bounds[1:])]
    return [f"{column} < {bounds[0]} OR {column} IS NULL", *inner, f"{column} >= {bounds[-1]}"]


def cdc_snapshot_jdbc(
    spark: SparkSession, url: str, table: str, key: str, bounds: Sequence[int], properties: dict[str, str] | None = None
) -> DataFrame:
    """Copy a database table with one connection per key range.

    ``bounds`` should be quantiles of the key, so ranges hold equally many rows
    however the keys are spread.
    """
    return spark.read.jdbc(url, table, predicates=range_predicates(key, bounds), properties=properties or {})


def snapshot_changes(rows: DataFrame, schema: str, table: str, keys: Sequence[str], lsn: int) -> DataFrame:
    """Rows of an initial copy as insert changes at the copy's position."""
    image = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    return rows.select(
        *[F.col(f"`{k}`") for k in keys],
        F.lit("I").alias("op"),
        F.lit(lsn).cast("bigint").alias("lsn"),
        F.lit(schema).alias("schema"),
        F.lit(table).alias("table"),
        F.lit(None).cast(T.StructType(rows.schema.fields)).alias("before"),
        image.alias("after"),
    )


def cdc_changes(
    spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "json", max_bytes: int | None = None
) -> DataFrame:
    """Change files as a stream; the checkpoint of the query that reads it is the
    position in the log, one checkpoint per pipeline."""
    read = spark.readStream.format(fmt).schema(schema).option("recursiveFileLookup", True)
    if max_bytes:
        read = read.option("maxBytesPerTrigger", max_bytes)
    return read.load(path)


def pipeline_checkpoint(root: str, pipeline_id: str | int) -> str:
    """Checkpoint folder of a pipeline; ids are positive whole numbers."""
    text = str(pipeline_id)
    if not (text.isascii() and text.isdigit() and not text.startswith("0")):
        raise ValueError("pipeline id must be a positive whole number")
    return f"{root.rstrip('/')}/pipeline={text}"
