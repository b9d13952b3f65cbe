"""Tables of documents: append, route, read, evolve, count, dump.

All tables live under one root as Parquet, partitioned by
``org / project / table / load_id``.  A row is a VARIANT document, so rows with
different keys share a table; Spark shreds the documents when it writes and
pushes the extracted fields into the scan when it reads.  A load is replaced as
a whole when it is written again under the same ``load_id``, which makes a
repeated batch harmless.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayline.functions.documents import field, typed_columns
from quayline.operators.writes import write_partitioned

PARTITIONS = ("org", "project", "table", "load_id")
TABLE_SCHEMA = "doc variant, origin string, org string, project string, table string, load_id string"
DEFAULT_NAMESPACE = ("default", "default")


# ---- writing


def write_routed(df: DataFrame, root: str, load_id: str) -> None:
    """Append rows with ``doc, origin, org, project, table`` to their tables.

    Tables come into being with their first row.  Rows are rebalanced by table:
    small tables get one file, one that holds most rows is split over many tasks.
    """
    rows = df.select("doc", "origin", "org", "project", "table", F.lit(load_id).alias("load_id"))
    write_partitioned(rows, root, "parquet", PARTITIONS[:3], PARTITIONS)


def append_table(
    df: DataFrame,
    root: str,
    table: str,
    load_id: str,
    namespace: tuple[str, str] = DEFAULT_NAMESPACE,
    origin: Column | None = None,
) -> None:
    """Append documents (``doc``) or typed rows (any other columns) to one table.

    One table needs no shuffle: every task writes its own rows.
    """
    origin = F.lit(None).cast("string") if origin is None else origin
    doc = F.col("doc") if "doc" in df.columns else row_document(df.columns)
    org, project = namespace
    names = {"org": org, "project": project, "table": table, "load_id": load_id}
    rows = df.select(doc.alias("doc"), origin.alias("origin"), *[F.lit(v).alias(k) for k, v in names.items()])
    (
        rows.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*PARTITIONS)
        .parquet(root)
    )


def row_document(columns: Sequence[str]) -> Column:
    """The row as a document.  Absent (NULL) fields become JSON nulls."""
    return F.to_variant_object(F.struct(*[F.col(f"`{c}`") for c in columns]))


# ---- reading


def read_tables(spark: SparkSession, root: str, folder: str = "") -> DataFrame:
    """All rows of all tables; a root nobody wrote to yet has no rows.

    ``folder`` is a pattern of partition folders below the root: only those are
    listed.
    """
    try:
        return spark.read.schema(TABLE_SCHEMA).option("basePath", root).parquet(root + folder)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], TABLE_SCHEMA)


def read_table(
    spark: SparkSession,
    root: str,
    table: str,
    schema: T.StructType | str | None = None,
    namespace: tuple[str, str] | None = None,
) -> DataFrame:
    """Rows of one table: documents, or typed columns read out of them.

    Only the folders of the table are listed, and only the named fields are read.
    """
    # A name with other characters is escaped in its folder; then all folders are
    # listed and the test on the partition column prunes them.
    plain = re.fullmatch(r"[A-Za-z0-9_.-]+", table)
    rows = read_tables(spark, root, f"/org=*/project=*/table={table}" if plain else "")
    rows = rows.where(F.col("table") == table)
    if namespace is not None:
        rows = rows.where((F.col("org") == namespace[0]) & (F.col("project") == namespace[1]))
    return rows if schema is None else rows.select(*typed_columns("doc", schema))


def create_table_view(
    spark: SparkSession, root: str, table: str, schema: T.StructType | str | None = None, name: str | None = None
) -> None:
    """Make a table known to Spark SQL under its own or another name, so that
    ``SELECT count(*) AS cnt FROM <table>`` can be asked (not ``count()``, which
    is no Spark SQL)."""
    read_table(spark, root, table, schema).createOrReplaceTempView(name or table)


def document_schema(df: DataFrame, doc: str = "doc") -> DataFrame:
    """The merged schema of all documents as one DDL-like text (``schema``)."""
    return df.agg(F.schema_of_variant_agg(doc).alias("schema"))


def infer_schema(df: DataFrame, doc: str = "doc") -> T.StructType:
    """Typed columns that hold every top-level field of the documents without loss.

    One aggregation over the table, and a second over the fields in which it met
    fractions; only the merged schema reaches the driver.  Numbers become
    BIGINT, DOUBLE if that keeps the digits of every value (up to 15), or DECIMAL of the
    width they need.  A field of unlike types in different rows, one that
    is NULL in all, and numbers no such type holds become text, so no value is lost.
    Documents that are no objects have no fields.
    """
    objects = df.where(F.startswith(F.schema_of_variant(doc), F.lit("OBJECT<")))
    text = document_schema(objects, doc).first()["schema"]
    if not text or not text.startswith("OBJECT<"):
        return T.StructType([])
    merged = T.StructType.fromDDL(text.replace("OBJECT<", "STRUCT<")[len("STRUCT<") : -1])
    doubtful = [f.name for f in merged.fields if isinstance(f.dataType, (T.DoubleType, T.DecimalType))]
    lossy = _lossy_doubles(objects, doc, doubtful) if doubtful else set()
    return T.StructType([T.StructField(f.name, _column_type(f.dataType, f.name in lossy)) for f in merged.fields])


def _lossy_doubles(objects: DataFrame, doc: str, names: Sequence[str]) -> set[str]:
    """Those fields in which some whole number or decimal is none that DOUBLE keeps."""

    def lost(name: str) -> Column:
        exact = F.regexp_replace(field(doc, name, "string"), "^-?0*[.]?0*|[.]", "")
        digits = F.length(F.regexp_replace(exact, "0+$", ""))
        fraction = F.schema_of_variant(field(doc, name, "variant")) == "DOUBLE"
        return F.coalesce(F.bool_or(~fraction & (digits > DOUBLE_DIGITS)), F.lit(False))

    found = objects.agg(*[lost(name).alias(f"lost_{i}") for i, name in enumerate(names)]).first()
    return {name for i, name in enumerate(names) if found[i]}


#: Decimal digits that DOUBLE always keeps.
DOUBLE_DIGITS = 15


def _column_type(kind: T.DataType, lossy: bool) -> T.DataType:
    if isinstance(kind, T.DecimalType):
        return kind if lossy else T.DoubleType()
    return T.StringType() if lossy or isinstance(kind, T.VariantType) else _without_void(kind)


def _without_void(kind: T.DataType) -> T.DataType:
    """What is NULL in all rows becomes text, at any depth."""
    if isinstance(kind, T.NullType):
        return T.StringType()
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_without_void(kind.elementType))
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _without_void(f.dataType)) for f in kind.fields])
    return kind


def read_typed(spark: SparkSession, root: str, table: str, namespace: tuple[str, str] | None = None) -> DataFrame:
    """Rows of a table with the columns its documents have by now: a new field is
    a new column, and rows without it hold NULL there."""
    rows = read_table(spark, root, table, namespace=namespace)
    return rows.select(*typed_columns("doc", infer_schema(rows)))


def dump_tables(spark: SparkSession, root: str) -> DataFrame:
    """Every row of every table as JSON text: ``table, json``."""
    return read_tables(spark, root).select("table", F.to_json("doc").alias("json"))


# ---- counting


def count_table(
    spark: SparkSession, root: str, table: str, namespace: tuple[str, str] | None = None
) -> DataFrame:
    """``cnt`` of one table; 0 for a table that does not exist.

    Reads no column: the count comes from row counts of the pruned files.
    """
    return read_table(spark, root, table, namespace=namespace).agg(F.count("*").alias("cnt"))


def table_counts(spark: SparkSession, root: str) -> DataFrame:
    """Rows per table."""
    return read_tables(spark, root).groupBy("org", "project", "table").agg(F.count("*").alias("cnt"))


# ---- union of unlike rows

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FRACTION = (T.FloatType, T.DoubleType)
_NESTED = (T.StructType, T.ArrayType, T.MapType, T.VariantType)


def _digits(kind: T.DataType) -> tuple[int, int]:
    """Digits before and behind the point."""
    if isinstance(kind, T.DecimalType):
        return kind.precision - kind.scale, kind.scale
    return {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 19}[type(kind)], 0


def merged_type(a: T.DataType, b: T.DataType, on_conflict: str = "string", exact: bool = False) -> T.DataType:
    """A type that holds every value of both; unlike kinds become text or VARIANT.

    Decimals and whole numbers become a decimal of the width both need.  BIGINT beside
    fractions becomes DOUBLE, which rounds beyond 2^53; ``exact`` takes it, as decimals
    beside fractions always, for unlike kinds.
    """
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(a, _WHOLE) and isinstance(b, _WHOLE):
        return T.LongType()
    if isinstance(a, _WHOLE + (T.DecimalType,)) and isinstance(b, _WHOLE + (T.DecimalType,)):
        before, behind = (max(pair) for pair in zip(_digits(a), _digits(b), strict=True))
        if before + behind <= 38:
            return T.DecimalType(before + behind, behind)
    rounds = exact and T.LongType() in (a, b)
    if isinstance(a, _WHOLE + _FRACTION) and isinstance(b, _WHOLE + _FRACTION) and not rounds:
        return T.DoubleType()
    return T.VariantType() if on_conflict == "variant" else T.StringType()


def _as_type(column: Column, have: T.DataType, want: T.DataType) -> Column:
    if have == want:
        return column
    if isinstance(want, T.StringType) and isinstance(have, _NESTED):
        return F.to_json(column)
    if isinstance(want, T.VariantType) and isinstance(have, _NESTED):
        return F.to_variant_object(column)
    return column.cast(want)


def merge_schemas(dfs: Sequence[DataFrame], on_conflict: str = "string", exact: bool = False) -> T.StructType:
    """Columns of all inputs by name, in order of first appearance."""
    if on_conflict not in ("string", "variant"):
        raise ValueError("on_conflict must be 'string' or 'variant'")
    types: dict[str, T.DataType] = {}
    for df in dfs:
        for f in df.schema.fields:
            types[f.name] = merged_type(types[f.name], f.dataType, on_conflict, exact) if f.name in types else f.dataType
    return T.StructType([T.StructField(name, kind) for name, kind in types.items()])


def union_all(dfs: Sequence[DataFrame], on_conflict: str = "string", exact: bool = False) -> DataFrame:
    """Append inputs with unlike columns.  Absent columns are NULL; a column whose
    types clash is widened before the union, so no value fails to convert."""
    schema = merge_schemas(dfs, on_conflict, exact)

    def widened(df: DataFrame) -> DataFrame:
        have = {f.name: f.dataType for f in df.schema.fields}
        return df.select(
            *[
                (_as_type(F.col(f"`{f.name}`"), have[f.name], f.dataType) if f.name in have else F.lit(None).cast(f.dataType))
                .alias(f.name)
                for f in schema.fields
            ]
        )

    return reduce(DataFrame.unionByName, [widened(df) for df in dfs])
