"""Object catalogs and the keys of files inside a root folder."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quayline.functions.text import col, url_decode_path
from quayline.operators.filters import filter_objects

_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"


def root_path(root: str) -> str:
    """Path of a root folder without scheme, authority and trailing slash."""
    return "/" + re.sub(_SCHEME, "", root).strip("/")


def object_key(path: Column | str, root: str, encoded: bool = True) -> Column:
    """Key of a file relative to ``root``.

    ``_metadata.file_path`` is a percent-encoded URI (``encoded=True``), while
    the path of a binaryFile scan is plain text.
    """
    full = col(path)
    if encoded:
        full = F.when(F.contains(full, F.lit("%")), url_decode_path(full)).otherwise(full)
    inside = F.regexp_replace(full, _SCHEME, "")
    depth = len(root_path(root).rstrip("/")) + 2
    return F.substr(inside, F.lit(depth))


def file_key(root: str) -> Column:
    """Key of the file a row was read from.  Predicates on it prune files."""
    return object_key("_metadata.file_path", root)


def prefix_path(root: str, prefix: str) -> str | None:
    """The part of the store that holds exactly the keys with a prefix, as a path
    pattern, so that nothing else is listed; None if no pattern can say it."""
    folder, _, name = prefix.rpartition("/")
    steps = folder.split("/") if folder else []
    if not all(steps) or any(step[0] in "._" for step in [*steps, name] if step):
        return None  # not a path as it stands, or hidden from a listing
    if not name and not steps[-1][-1].isalnum():
        return None
    escaped = [re.sub(r"([\\{}\[\]*?,^])", r"\\\1", step) for step in [*steps, name]]
    if name:
        escaped[-1] += "*"
    else:
        # A pattern even where a plain path would do: it may match nothing.
        escaped = [*escaped[:-2], escaped[-2][:-1] + f"[{escaped[-2][-1]}]"]
    return "/".join([root.rstrip("/"), *escaped])


def load_keys(
    load: Callable[[str], DataFrame],
    root: str,
    key: Callable[[], Column],
    prefix: str | None = None,
    pattern: str | None = None,
    internal_prefixes: Iterable[str] = (),
    name: str = "key",
) -> DataFrame:
    """Load the files with matching keys and add the key of each row.

    The prefix narrows the listing; the other tests are predicates on the file
    path, which prune files before any is opened.
    """
    path = prefix_path(root, prefix) if prefix else root
    rows = None
    if path is not None:
        try:
            rows = load(path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND" or path == root:
                raise
    # Without a narrowed path (or with nothing under it) the key itself is tested.
    test = None if rows is not None else prefix
    rows = load(root) if rows is None else rows
    keyed = rows.withColumn(name, key())
    return filter_objects(keyed, name, None, test, pattern, internal_prefixes)


def object_catalog(
    spark: SparkSession, root: str, prefix: str | None = None, internal_prefixes: Iterable[str] = ()
) -> DataFrame:
    """Every file below ``root``: ``key, path, length, modified``.

    The listing runs on Spark's parallel file index and reads no file content.
    Names that start with ``.`` or ``_`` and files of zero bytes are hidden, as in
    every Spark scan; for a store too big to list, pass an inventory table with
    the same columns to the operators instead.
    """
    # Spark plans one task per 128 MB of files though no content is read; a
    # hundred terabytes would be most of a million idle tasks.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    plain_key = lambda: object_key("path", root, encoded=False)
    files = load_keys(read.load, root, plain_key, prefix, None, internal_prefixes)
    return files.select("key", "path", "length", F.col("modificationTime").alias("modified")).coalesce(tasks)
