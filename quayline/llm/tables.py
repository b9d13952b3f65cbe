"""Helpers that the operators here share: inputs, sizes, written steps, Arrow maps."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quayline.session import run_folder


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a step to the shared folder and read it back.

    This cuts the lineage: a lost executor repeats reads of these files, not the work.
    """
    folder = run_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


class Steps:
    """Written steps of one run, each deleted when nothing reads it any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, run_folder(spark, name)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """As ``written``, under this run's folder."""
        df.write.parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        """Delete steps whose successors are written: no lost task will read them."""
        jvm = self.spark._jvm
        # Spark removes the shuffle files of plans that nobody holds when the driver
        # collects its garbage, which else may take until the disks are full.
        gc.collect()
        jvm.System.gc()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def give_back() -> None:
    """Return what this worker has freed to the system, so that the JVM beside it can use
    it while the worker waits for its next task."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def input_bytes(df: DataFrame) -> int:
    """Spark's own estimate of a plan's size, from file sizes; no job runs."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def bucket_count(df: DataFrame, bytes_each: int) -> int:
    """Buckets so that each gets about ``bytes_each`` of the input, however large."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = input_bytes(df)
    return max(least, -(-size // bytes_each)) if size < 1 << 60 else least


def map_batches(
    df: DataFrame, columns: list[str], schema: str, make: Callable[[], Callable[[pa.RecordBatch], dict | None]]
) -> DataFrame:
    """Run a function over Arrow batches of some columns.

    ``make`` runs once per task and gives the function that turns one batch into
    columns named as in ``schema``.  Other columns of ``df``, whatever their names,
    never reach Python.
    """
    fields = StructType.fromDDL(schema)
    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        for batch in batches:
            made = one(batch)
            if made is not None:
                yield pa.RecordBatch.from_arrays(
                    [made[f.name] if isinstance(made[f.name], pa.Array) else pa.array(made[f.name], f.type) for f in arrow],
                    schema=arrow,
                )
        give_back()

    return df.select(*columns).mapInArrow(run, fields)
