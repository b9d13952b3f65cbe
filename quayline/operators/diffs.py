"""Differences between two versions of a table or of a row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def changed(pairs: Sequence[tuple[str, Column, Column]]) -> Column:
    """Names of the columns whose two values differ; NULL equals NULL."""
    names = F.array(*[F.when(~a.eqNullSafe(b), F.lit(name)) for name, a, b in pairs])
    return F.array_compact(names)


def table_diff(desired: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key: ``change`` is added (desired only), removed, changed or same, and
    ``columns`` lists what differs.  The keys identify a row on each side."""
    values = [c for c in desired.columns if c not in keys]
    d = desired.select(*keys, F.struct(*values).alias("_desired"))
    a = actual.select(*keys, F.struct(*values).alias("_actual"))
    names = changed([(c, F.col("_desired")[c], F.col("_actual")[c]) for c in values])
    change = (
        F.when(F.col("_actual").isNull(), "added")
        .when(F.col("_desired").isNull(), "removed")
        .when(F.size(names) > 0, "changed")
        .otherwise("same")
    )
    joined = d.join(a, list(keys), "full_outer").withColumn("change", change)
    return joined.select(
        *keys, "change", F.when(F.col("change") == "changed", names).otherwise(F.array().cast("array<string>")).alias("columns")
    )
