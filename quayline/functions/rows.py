"""Control over how often an expression is evaluated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that are computed exactly once per row.

    The optimizer pushes a filter on a plain column below its projection and so
    computes the column again for each filter.  It does not push filters below a
    generator; for costly expressions, such as parsing, one row in and one row
    out of ``inline`` keeps the work single.
    """
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(row)))
