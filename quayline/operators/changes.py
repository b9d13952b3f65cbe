"""Database change rows: publication, bootstrap, log, current state.

A change row is ``op`` (I, U, D), ``lsn``, ``ts``, ``schema``, ``table``,
``before`` and ``after`` (structs of the source row).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayline.functions.names import destination_name
from quayline.operators.diffs import changed


def publication_filter(changes: DataFrame, published: DataFrame) -> DataFrame:
    """Changes of the published ``(schema, table)`` pairs."""
    return changes.join(published.select("schema", "table"), ["schema", "table"], "left_semi")


def latest(changes: DataFrame, keys: Sequence[str], order: Sequence[str | Column] = ("lsn",)) -> DataFrame:
    """The last change of each key, deletes included.

    Spark keeps only the best row per key and map task before it shuffles.
    """
    newest = [F.col(c).desc() if isinstance(c, str) else c.desc() for c in order]
    ranked = Window.partitionBy(*keys).orderBy(*newest)
    return changes.withColumn("_rank", F.row_number().over(ranked)).where("_rank = 1").drop("_rank")


def cdc_current(changes: DataFrame, keys: Sequence[str], order: Sequence[str | Column] = ("lsn",)) -> DataFrame:
    """Current rows: the last change of each key unless it is a delete."""
    return latest(changes, keys, order).where(F.col("op") != "D")


def bootstrap_and_tail(snapshot: DataFrame, changes: DataFrame, snapshot_lsn: int) -> DataFrame:
    """A copy taken at ``snapshot_lsn``, as inserts, and every later change: no
    change is missed and none is applied twice."""
    copied = snapshot.withColumn("op", F.lit("I")).withColumn("lsn", F.lit(snapshot_lsn).cast("bigint"))
    return copied.unionByName(changes.where(F.col("lsn") > snapshot_lsn), allowMissingColumns=True)


def change_columns(changes: DataFrame, before: str = "before", after: str = "after") -> DataFrame:
    """Add ``changed_columns`` of each update, from the full old and new rows."""
    fields = changes.schema[after].dataType.names
    names = changed([(f, F.col(before)[f], F.col(after)[f]) for f in fields])
    update = F.col("op") == "U"
    return changes.withColumn(
        "changed_columns", F.when(update, names).otherwise(F.array().cast("array<string>"))
    )


def row_texts(struct: Column, fields: Sequence[str]) -> Column:
    """A source row as a document of text values, whatever the column types."""
    return F.to_variant_object(F.struct(*[struct[f].cast("string").alias(f) for f in fields]))


def change_rows(changes: DataFrame, org: str = "default", project: str = "default") -> DataFrame:
    """Change rows ready for :func:`write_routed`: each goes to the table named
    after its source; the values of the row (old row for a delete) are text."""
    fields = changes.schema["after"].dataType.names
    image = F.when(F.col("op") == "D", F.col("before")).otherwise(F.col("after"))
    return changes.select(
        row_texts(image, fields).alias("doc"),
        F.concat_ws(":", "op", "lsn").alias("origin"),
        F.lit(org).alias("org"),
        F.lit(project).alias("project"),
        destination_name("schema", "table").alias("table"),
    )
