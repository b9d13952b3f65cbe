"""Scans of JSON, CSV and Parquet files with unlike keys.

Without a schema every scan returns ``key`` (of the file) and ``doc`` (VARIANT),
so files with different fields can go into one table.  With a schema it returns
typed columns.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayline.functions.constants import FORMAT_EXTENSIONS, WHITE_SPACE
from quayline.functions.documents import STRICT_JSON, document, parsed_document, type_text, typed_columns
from quayline.functions.text import col, trim_space
from quayline.sources.arrays import BLANK, array_elements
from quayline.sources.objects import file_key, load_keys

LINES_NAME = r"(?i)[.](jsonl|ndjson)([.]gz)?$"
WHOLE_FILE_LIMIT = 128 * 1024 * 1024
#: Bigger files are cut into lines where they lie if they are JSON Lines.
LOOKED_INTO = 8 * 1024 * 1024
LINE_LIMIT = 16 * 1024 * 1024
LAYOUTS = ("auto", "lines", "whole")
BYTE_ORDER_MARK = "\ufeff"


def format_glob(fmt: str) -> str:
    """File-name glob of a format that ignores case, applied while listing."""
    def any_case(suffix: str) -> str:
        return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in suffix)

    return "*{" + ",".join(any_case(s) for s in FORMAT_EXTENSIONS[fmt]) + "}"


def _reader(spark: SparkSession, fmt: str | None):
    read = spark.read.option("recursiveFileLookup", True)
    # The format is tested on file names while listing, not row by row.
    return read.option("pathGlobFilter", format_glob(fmt)) if fmt in FORMAT_EXTENSIONS else read


def _typed(rows: DataFrame, schema: T.StructType | str | None, keep_key: bool) -> DataFrame:
    if schema is None:
        return rows
    key = ["key"] if keep_key else []
    return rows.select(*key, *typed_columns("doc", schema))


def named_as_lines():
    """Test on the name of the file a row comes from: JSON Lines by its suffix."""
    return F.rlike(F.col("_metadata.file_name"), F.lit(LINES_NAME))


def json_lines(df: DataFrame) -> DataFrame:
    """``key, line`` -> ``key, doc``; blank lines are dropped, and a line that is no
    document is kept as text."""
    return df.where(trim_space("line") != "").select("key", document(_strip("line")).alias("doc"))


def json_whole(df: DataFrame, with_lines: bool = True) -> DataFrame:
    """``key, body`` (one row per file) -> ``key, doc``.

    If the first line that is not blank is a document by itself the file is JSON
    Lines, and a line that is none is kept as text; otherwise the body is one array or
    one document.  An array yields its elements.  Only bodies of JSON Lines are cut into
    lines; without ``with_lines`` they yield nothing, as what reads them line by line
    has their rows.
    """
    body = _json_text("body")
    is_lines = _is_lines(_first_line(_strip_left("body")))
    # Text after the end of an array makes the wrapped text malformed.
    wrapped = F.from_json(F.concat(F.lit('{"items":'), body, F.lit("}")), "items array<variant>", STRICT_JSON)
    of_body = F.coalesce(wrapped["items"], F.array(F.coalesce(parsed_document(body), _strip("body").cast("variant"))))
    # The line ends of Spark's text reader; what stands between \r and \n is blank.
    lines = F.filter(F.split(_strip("body"), "[\r\n]", -1), lambda x: trim_space(x) != "")
    of_lines = F.flatten(F.transform(F.transform(lines, lambda x: document(_strip(x))), _elements))
    if not with_lines:
        return df.where(~is_lines).select("key", F.explode(of_body).alias("doc"))
    return df.select("key", F.explode(F.when(is_lines, of_lines).otherwise(of_body)).alias("doc"))


def _filled(c: Column | str) -> Column:
    """The text from its first sign on that is neither blank nor a byte order mark."""
    return F.ltrim(col(c), F.lit(BYTE_ORDER_MARK + WHITE_SPACE))


def _first_line(body: Column) -> Column:
    """The first line with anything in it, "" if there is none."""
    filled = _filled(body)
    before = F.substring(body, F.lit(1), F.length(body) - F.length(filled))
    begin = F.substring_index(F.substring_index(before, "\n", -1), "\r", -1)
    return F.concat(begin, F.substring_index(F.substring_index(filled, "\n", 1), "\r", 1))


def _is_lines(head: Column | str) -> Column:
    """Whether a file with this first line is JSON Lines; so is one without any."""
    return F.coalesce((_filled(head) == "") | parsed_document(_json_text(head)).isNotNull(), F.lit(False))


def _strip(c: Column | str):
    return F.btrim(col(c), F.lit(BLANK))


def _strip_left(c: Column | str):
    return F.ltrim(col(c), F.lit(BLANK))


def _json_text(c: Column | str):
    """A text that may be a file, stripped as far as parsing needs it.  Trimming on the
    right takes eight bytes of memory for each byte of a text; blanks there hurt no parser."""
    left = _strip_left(c)
    return F.when(F.contains(left, F.lit(BYTE_ORDER_MARK)), _strip(left)).otherwise(left)


def _elements(doc):
    """The elements of an array document; any other document by itself."""
    return F.coalesce(F.try_variant_get(doc, "$", "array<variant>"), F.array(doc))


def json_big(df: DataFrame) -> DataFrame:
    """``key, line, split`` of files that no task should hold -> ``key, doc``, as
    ``json_whole`` reads them.  ``split`` is the place in the file where the split of the
    line begins.

    The first line that is not blank, found in the split a file begins with, decides.  If
    it is no document the file is one body: one line is kept as text, else it is one
    array, which is read element by element, or the query stops.
    """
    filled = df.where(trim_space("line") != "")
    heads = _heads(filled)
    # An array in a line longer than a value may be is cut into its elements, too.
    fits = (F.length("head") <= LINE_LIMIT) | ~F.startswith(_strip("head"), F.lit("["))
    is_lines = F.when(fits, parsed_document(_strip("head")).isNotNull()).otherwise(False)
    alone = ~is_lines & fits & (F.col("_n") == 1)
    heads = heads.select(F.col("key").alias("_of"), (is_lines | alone).alias("_by_line"), alone.alias("_alone"))
    rows = filled.join(heads, F.col("key") == F.col("_of"), "left").withColumn("_by_line", F.coalesce("_by_line", F.lit(False)))
    by_line = rows.where("_by_line")
    stop = F.raise_error(F.concat(F.lit("not JSON Lines, pass layout='whole': "), F.col("key"))).cast("string").cast("variant")
    docs = by_line.select("key", F.when(F.col("_alone") & (F.col("split") > 0), stop).otherwise(document(_strip("line"))).alias("doc"))
    docs = docs.select("key", F.explode(_elements(F.col("doc"))).alias("doc"))
    return docs.unionByName(array_elements(rows.where("not _by_line").select("key", "split", "line")))


def _heads(lines: DataFrame) -> DataFrame:
    """``key, head, _n``: the first line of each file and how many its first split has."""
    starts = lines.where("split = 0").select("key", "line", F.monotonically_increasing_id().alias("_line"))
    return starts.groupBy("key").agg(F.min_by("line", "_line").alias("head"), F.count("*").alias("_n"))


def json_by_line(df: DataFrame) -> DataFrame:
    """``key, line, split`` -> ``key, doc`` of those files that are JSON Lines."""
    named = _heads(df.where(_filled("line") != "")).where(_is_lines("head")).select(F.col("key").alias("_of"))
    docs = json_lines(df.join(named, F.col("key") == F.col("_of"), "left_semi"))
    return docs.select("key", F.explode(_elements(F.col("doc"))).alias("doc"))


def scan_json(
    spark: SparkSession,
    root: str,
    layout: str = "auto",
    schema: T.StructType | str | None = None,
    prefix: str | None = None,
    fmt: str | None = None,
    pattern: str | None = None,
    internal_prefixes: Iterable[str] = (),
    keep_key: bool = False,
    whole_file_limit: int = WHOLE_FILE_LIMIT,
    looked_into: int = LOOKED_INTO,
) -> DataFrame:
    """Documents of JSON files: arrays, single documents and JSON Lines.

    ``lines`` splits big files over tasks; ``whole`` holds one file at a time in
    memory, of 2 GB at most, as an array cannot be split; ``auto``
    reads ``.jsonl``/``.ndjson`` names as lines and looks into all others: if the first
    line that is not blank is a document the file is JSON Lines.  Files over ``looked_into``
    bytes (gzip: an eighth of it) are looked into first, and those that are JSON Lines are
    split as such; only arrays and single documents are held.  Files over
    ``whole_file_limit`` bytes, which no task should hold, are read line by line by the
    same rule with the same result; a second pass over the beginning of each finds its
    first line.  If that is no document, an array is cut into its elements where it lies
    (see ``array_elements``); one document or text over many lines, which could only be
    one value of that size, stops the query, and ``layout="whole"`` reads it.
    Gzip is decoded by file name.

    ``lines`` with a schema parses straight into columns, without documents in
    between, which is several times faster; there a value of another type than
    its column is NULL, while documents convert it if they can.
    """
    if layout not in LAYOUTS:
        raise ValueError(f"layout must be one of {LAYOUTS}")

    keys = {"prefix": prefix, "pattern": pattern, "internal_prefixes": internal_prefixes}
    if layout == "lines" and schema is not None:
        read = _reader(spark, fmt).schema(schema).options(**STRICT_JSON)
        rows = load_keys(read.json, root, lambda: file_key(root), **keys, name="_key")
        names = [F.col(f"`{c}`") for c in rows.columns if c != "_key"]
        return rows.select(*([F.col("_key").alias("key")] if keep_key else []), *names)

    def files(whole: bool) -> DataFrame:
        load = partial(_reader(spark, fmt).text, wholetext=whole)
        return load_keys(load, root, lambda: file_key(root), **keys)

    def lines() -> DataFrame:
        return files(False).withColumnRenamed("value", "line")

    def whole() -> DataFrame:
        return files(True).withColumnRenamed("value", "body")

    if layout == "lines":
        rows = json_lines(lines())
    elif layout == "whole":
        rows = json_whole(whole())
    else:
        # Scans of disjoint files: the predicates use file metadata only, so each
        # scan drops the files of the others while it is planned.
        size, held = F.col("_metadata.file_size"), min(looked_into, whole_file_limit)
        big = ~named_as_lines() & (size > whole_file_limit)
        packed = F.rlike(F.col("_metadata.file_name"), F.lit("(?i)[.]gz$"))
        middle = ~named_as_lines() & ~big & (size > F.when(packed, held // 8).otherwise(held))
        named = json_lines(lines().where(named_as_lines()))
        rows = named.unionByName(json_whole(whole().where(~named_as_lines() & ~big & ~middle)))
        # The listing has none of them in most cases: this reads nothing then, else one row.
        some_lines = lines().where(middle).withColumn("split", F.col("_metadata.file_block_start"))
        if not some_lines.select("key").isEmpty():
            rows = rows.unionByName(json_by_line(some_lines)).unionByName(json_whole(whole().where(middle), with_lines=False))
        some_lines = lines().where(big).withColumn("split", F.col("_metadata.file_block_start"))
        if not some_lines.select("key").isEmpty():
            rows = rows.unionByName(json_big(some_lines))
    return _typed(rows, schema, keep_key)


def scan_csv(
    spark: SparkSession,
    root: str,
    header: bool = True,
    schema: T.StructType | str | None = None,
    prefix: str | None = None,
    fmt: str | None = None,
    pattern: str | None = None,
    internal_prefixes: Iterable[str] = (),
    keep_key: bool = False,
    multi_line: bool = False,
    same_header: bool = False,
) -> DataFrame:
    """Rows of CSV files; the header of each file names the fields of its rows.

    Without a schema a row becomes a document whose values keep the scalar type
    they look like.  With one, columns are read by name of the header, so files
    whose columns differ or are ordered differently still line up; values go from
    their text straight to the column's type, so a text column keeps every sign of
    ``01234`` or ``1.10``.  A quote in a quoted value is doubled; ``multi_line`` allows line breaks in quoted values,
    at the price of reading each file in one task.

    ``same_header`` says that every file has just the columns of the schema in its
    order (a file with others stops the query); rows are then parsed straight into
    columns, which is several times faster.
    """
    read = _reader(spark, fmt).options(header=header, escape='"', multiLine=multi_line)
    by_position = schema is not None and (same_header or not header)
    if schema is not None and not by_position:
        return _csv_by_name(spark, root, schema, fmt, multi_line, (prefix, pattern, internal_prefixes), keep_key)
    read = read.option("enforceSchema", not same_header)
    read = read.schema(schema) if by_position else read.option("singleVariantColumn", "doc")
    rows = load_keys(read.csv, root, lambda: file_key(root), prefix, pattern, internal_prefixes)
    if by_position:
        return rows if keep_key else rows.drop("key")
    return rows.select("key", "doc")


def _csv_by_name(
    spark: SparkSession, root: str, schema: T.StructType | str, fmt: str | None, multi_line: bool, keys: tuple, keep_key: bool
) -> DataFrame:
    """Typed columns by the names in each file's own header, one row per file of which
    is joined to the file's rows; the rows themselves are parsed as text."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    lines = load_keys(_reader(spark, fmt).text, root, lambda: file_key(root), *keys)
    starts = lines.where((F.col("_metadata.file_block_start") == 0) & (trim_space("value") != ""))
    placed = starts.select("key", "value", F.monotonically_increasing_id().alias("_line"))
    heads = placed.groupBy("key").agg(F.min_by("value", "_line").alias("head"))
    width = heads.agg(F.max(F.size(F.split("head", ",")))).first()[0] or 1
    places = T.StructType([T.StructField(f"_{k}", T.StringType()) for k in range(width)])
    names = F.from_csv(F.ltrim("head", F.lit(BYTE_ORDER_MARK)), places.simpleString()[len("struct<") : -1].replace(":", " "), {"escape": '"'})
    heads = heads.select(F.col("key").alias("_of"), names.alias("_names"))
    heads = heads.select("_of", F.array(*[F.col(f"_names._{k}") for k in range(width)]).alias("_names"))
    read = _reader(spark, fmt).options(header=True, escape='"', multiLine=multi_line, enforceSchema=True).schema(places)
    rows = load_keys(read.csv, root, lambda: file_key(root), *keys)
    rows = rows.select("key", F.array(*places.names).alias("_values")).join(heads, F.col("key") == F.col("_of"))

    def value(f: T.StructField) -> Column:
        text = F.get("_values", F.array_position("_names", F.lit(f.name)).cast("int") - 1)
        if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType, T.VariantType)):
            return F.try_variant_get(document(text), "$", type_text(f.dataType))
        return text.try_cast(f.dataType)

    return rows.select(*(["key"] if keep_key else []), *[value(f).alias(f.name) for f in schema.fields])


def scan_parquet(
    spark: SparkSession,
    root: str,
    merge_schema: bool = False,
    schema: T.StructType | str | None = None,
    as_documents: bool = False,
    prefix: str | None = None,
    fmt: str | None = "parquet",
    pattern: str | None = None,
    internal_prefixes: Iterable[str] = (),
    keep_key: bool = False,
) -> DataFrame:
    """Rows of Parquet files (``.parquet``, ``.pq``) with their own columns, or as
    documents.  Column pruning and predicate push-down reach the files."""
    read = _reader(spark, fmt).option("mergeSchema", merge_schema)
    if schema is not None:
        read = read.schema(schema)
    keyed = load_keys(read.parquet, root, lambda: file_key(root), prefix, pattern, internal_prefixes, name="_key")
    names = [c for c in keyed.columns if c != "_key"]
    if as_documents:
        row = F.to_variant_object(F.struct(*[F.col(f"`{n}`") for n in names]))
        return keyed.select(F.col("_key").alias("key"), row.alias("doc"))
    key = [F.col("_key").alias("key")] if keep_key else []
    return keyed.select(*key, *[F.col(f"`{n}`") for n in names])


def read_objects(
    spark: SparkSession,
    root: str,
    fmt: str,
    prefix: str | None = None,
    pattern: str | None = None,
    internal_prefixes: Iterable[str] = (),
    layout: str = "auto",
) -> DataFrame:
    """All rows of the matching files as ``key, doc``.

    The key filters become predicates on the file path, which Spark evaluates
    while it lists: files that do not match are never opened.
    """
    keys = {"prefix": prefix, "pattern": pattern, "internal_prefixes": internal_prefixes, "fmt": fmt}
    if fmt == "csv":
        return scan_csv(spark, root, **keys)
    if fmt == "parquet":
        return scan_parquet(spark, root, merge_schema=True, as_documents=True, **keys)
    if fmt != "json":
        raise ValueError(f"unknown format: {fmt}")
    return scan_json(spark, root, layout, **keys)
