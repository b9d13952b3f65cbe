"""Column selection, ordering, sampling and unnesting."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayline.functions import constants as K
from quayline.functions import text


def canonical_order(fields: Sequence[str], ranking: Sequence[str] = K.CDN_FIELDS) -> list[str]:
    """Fields by their place in the ranking; unknown ones last, as they came."""
    place = {name: i for i, name in enumerate(ranking)}
    return sorted(fields, key=lambda name: place.get(name, len(ranking)))


def canonical_columns(df: DataFrame, ranking: Sequence[str] = K.CDN_FIELDS) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in canonical_order(df.columns, ranking)])


def select_fields(df: DataFrame, fields: Sequence[str | None] | None = None) -> DataFrame:
    """Keep the named log fields (default: the default fields), in canonical order."""
    named = [f for f in fields or () if f is not None] or list(K.CDN_DEFAULT_FIELDS)
    return df.select(*[F.col(f"`{c}`") for c in canonical_order(named)])


def sample_percent(df: DataFrame, key_col: str, rate: int) -> DataFrame:
    """Keep ``rate`` percent (1-100) of the keys, always the same ones.

    A key kept at one rate is kept at every higher rate.
    """
    low, high, _ = K.SAMPLING_PERCENT
    if not low <= rate <= high:
        raise ValueError(f"rate must be between {low} and {high}")
    if rate == high:
        return df
    digits = F.left(text.sha256_hex(F.col(key_col).cast("string")), F.lit(8))
    return df.where(F.conv(digits, 16, 10).cast("bigint") % 100 < rate)


def mask_columns(df: DataFrame, columns: Iterable[str], style: str = "edges") -> DataFrame:
    return df.withColumns({c: text.mask(c, style) for c in columns})


def stringify(df: DataFrame) -> DataFrame:
    """Every column as text; nested columns as JSON."""
    return df.select(*[_as_text(f).alias(f.name) for f in df.schema.fields])


def _as_text(f):
    column = F.col(f"`{f.name}`")
    if f.dataType.typeName() in ("struct", "array", "map", "variant"):
        return F.to_json(column)
    return column.cast("string")


def order_by_rank(df: DataFrame, column: str, ranking: Sequence[str], position: str) -> DataFrame:
    """Sort by the place of a value in ``ranking``; unknown values come last.

    ``position`` breaks ties, because a distributed sort keeps no input order.
    """
    return df.orderBy(rank_of(column, ranking), F.col(position))


def rank_of(column: str, ranking: Sequence[str]):
    """1-based place of a value in the ranking; unknown values get the next number."""
    places = F.array(*[F.lit(v) for v in ranking])
    found = F.coalesce(F.array_position(places, F.col(column)), F.lit(0))
    return F.when(found > 0, found).otherwise(F.lit(len(ranking) + 1)).cast("int")


def sorted_entries(df: DataFrame, map_col: str) -> DataFrame:
    """One row per value of a ``map<string, array<string>>``, keys in order and
    the values of a key in the order they came: ``pos, name, value_pos, value``."""
    keep = [c for c in df.columns if c != map_col]
    entries = df.select(*keep, F.posexplode(F.array_sort(F.map_keys(map_col))).alias("pos", "name"), map_col)
    return entries.select(
        *keep, "pos", "name", F.posexplode(F.element_at(map_col, F.col("name"))).alias("value_pos", "value")
    )
