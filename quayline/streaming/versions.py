"""Current rows as a table of immutable versions that a lost driver can't damage.

Layout under the table's root::

    data/<version>-<name>/          files of one commit, never changed afterwards
    _versions/<version>.json        which folders make up a version; switched by one rename

A version is a base (per hash bucket the folder that holds its rows, one row per key) and a
list of deltas (one folder per commit, sorted by bucket and key).  A commit writes only its
own changes and then the manifest under the next number; until that rename nothing has
happened, after it everything has.  Readers merge the buckets that deltas touch and take all
others as they are.  When deltas hold a share of the base's rows, their buckets are folded
into a new base folder, so every row is rewritten a bounded number of times on average.

A manifest has an entry per bucket and delta, all that the driver handles.  One writer per
table: a second one finds its version's number taken and fails without having changed
anything.  ``vacuum`` deletes what the last versions no longer name, leftovers of killed
writers included.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayline.operators.changes import latest
from quayline.operators.writes import write_partitioned

IDENTITY = ("schema", "table")
BUCKET = "bucket"
#: Fold deltas when they hold this share of the base's rows, or are so many.
FOLD_SHARE = 0.25
FOLD_COUNT = 32
#: Changes per file of a delta.
FILE_ROWS = 1_000_000


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*IDENTITY, *keys), F.lit(buckets)).cast("int")


class Store:
    """The files of one versioned table."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark._jvm
        self.conf = spark._jsparkSession.sessionState().newHadoopConf()
        self.fs = self._path("").getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(path)) if self.fs.exists(path) else []

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in self._names("_versions") if n.endswith(".json") and not n.startswith(".")]

    def manifest(self, version: int | None = None) -> dict | None:
        """A version's manifest, the last one's by default; None if there is no version."""
        known = self.versions()
        version = known[-1] if version is None and known else version
        if version is None:
            return None
        if version not in known:
            raise ValueError(f"{self.root} has no version {version}")
        stream = self.fs.open(self._path(f"_versions/{version:020d}.json"))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, manifest: dict) -> None:
        """Make a manifest the table's next version, or fail if that is taken."""
        staged = self._path(f"_versions/.{uuid.uuid4().hex}")
        stream = self.fs.create(staged, False)
        try:
            stream.write(bytearray(json.dumps(manifest).encode()))
        finally:
            stream.close()
        files = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self.conf)
        # Without options a rename never replaces a file that is there.
        plain = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        files.rename(staged, self._path(f"_versions/{manifest['version']:020d}.json"), plain)

    def new_folder(self, version: int) -> str:
        return f"data/{version:020d}-{uuid.uuid4().hex[:12]}"

    def read_base(self, manifest: dict, schema: T.StructType, buckets: Sequence[int]) -> list[DataFrame]:
        """Base rows of some buckets, one DataFrame per folder."""
        folders: dict[str, list[int]] = {}
        for b in buckets:
            if str(b) in manifest["base"]:
                folders.setdefault(manifest["base"][str(b)]["folder"], []).append(b)
        stored = T.StructType([*schema.fields, T.StructField(BUCKET, T.IntegerType())])
        read = self.spark.read.schema(stored)
        return [
            read.option("basePath", f"{self.root}/{f}").parquet(*[f"{self.root}/{f}/{BUCKET}={b}" for b in some])
            for f, some in folders.items()
        ]

    def read_deltas(self, manifest: dict, schema: T.StructType) -> list[DataFrame]:
        folders = [f"{self.root}/{d['folder']}" for d in manifest["deltas"]]
        stored = T.StructType([*schema.fields, T.StructField(BUCKET, T.IntegerType())])
        return [self.spark.read.schema(stored).parquet(*folders)] if folders else []

    def bucket_rows(self, folder: str) -> dict[int, int]:
        """Rows per bucket of a written folder, from that one column: at most as many
        numbers as there are buckets."""
        rows = self.spark.read.schema(f"{BUCKET} int").parquet(f"{self.root}/{folder}")
        return {r[BUCKET]: r["count"] for r in rows.groupBy(BUCKET).count().collect()}


def _touched(manifest: dict) -> list[int]:
    return sorted({b for d in manifest["deltas"] for b in d["buckets"]})


def _rows(parts: list[DataFrame], spark: SparkSession, schema: T.StructType) -> DataFrame:
    stored = T.StructType([*schema.fields, T.StructField(BUCKET, T.IntegerType())])
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], stored)


def read_current(
    spark: SparkSession, root: str, schema: T.StructType, deleted: bool = False, version: int | None = None
) -> DataFrame:
    """Current rows of all replicated tables, of the last or an earlier version; with
    ``deleted`` also tombstones.  A table nobody wrote to yet has no rows."""
    store = Store(spark, root)
    manifest = store.manifest(version)
    if manifest is None:
        rows = _rows([], spark, schema)
    else:
        touched = _touched(manifest)
        merged = store.read_base(manifest, schema, touched) + store.read_deltas(manifest, schema)
        merged = [latest(_rows(merged, spark, schema), [*IDENTITY, *manifest["keys"]])] if touched else []
        others = [int(b) for b in manifest["base"] if int(b) not in set(touched)]
        rows = _rows(merged + store.read_base(manifest, schema, others), spark, schema)
    return (rows if deleted else rows.where(F.col("op") != "D")).drop(BUCKET)


def merge_changes(
    batch: DataFrame, root: str, keys: Sequence[str], buckets: int, source: str | None = None, number: int | None = None
) -> None:
    """Fold change rows into the current table as one new version.

    What is written is what the batch holds: of each key its last change by ``lsn``.
    Deletes leave a tombstone, so applying a batch again, or late, changes nothing.  A
    numbered batch of a named source that the table already holds isn't written again.
    """
    spark, store = batch.sparkSession, Store(batch.sparkSession, root)
    manifest = store.manifest() or {"version": 0, "keys": list(keys), "buckets": buckets, "base": {}, "deltas": [], "applied": {}}
    if manifest["keys"] != list(keys) or manifest["buckets"] != buckets:
        raise ValueError(f"{root} has keys {manifest['keys']} and {manifest['buckets']} buckets")
    if source is not None and manifest["applied"].get(source, -1) >= number:
        return
    rows = batch.count()
    if rows:
        version = manifest["version"] + 1
        folder = store.new_folder(version)
        last = latest(batch, [*IDENTITY, *keys]).withColumn(BUCKET, bucket_of(keys, buckets))
        last.coalesce(-(-rows // FILE_ROWS)).sortWithinPartitions(BUCKET, *IDENTITY, *keys).write.parquet(f"{store.root}/{folder}")
        found = store.bucket_rows(folder)
        delta = {"folder": folder, "buckets": sorted(found), "rows": sum(found.values())}
        applied = manifest["applied"] | ({source: number} if source is not None else {})
        manifest = manifest | {"version": version, "deltas": [*manifest["deltas"], delta], "applied": applied}
        store.commit(manifest)
    held = sum(b["rows"] for b in manifest["base"].values())
    waiting = sum(d["rows"] for d in manifest["deltas"])
    if waiting and (waiting >= FOLD_SHARE * held or len(manifest["deltas"]) >= FOLD_COUNT):
        fold(spark, root, batch.schema)


def fold(spark: SparkSession, root: str, schema: T.StructType) -> None:
    """Merge all deltas into the base, as one new version with the same rows.  Only
    buckets that deltas touch are read and written."""
    store = Store(spark, root)
    manifest = store.manifest()
    if manifest is None or not manifest["deltas"]:
        return
    touched, version = _touched(manifest), manifest["version"] + 1
    parts = store.read_base(manifest, schema, touched) + store.read_deltas(manifest, schema)
    merged = latest(_rows(parts, spark, schema), [*IDENTITY, *manifest["keys"]])
    _new_base(store, merged, manifest | {"version": version, "deltas": []})


def _new_base(store: Store, rows: DataFrame, manifest: dict) -> None:
    """Write rows as the base of their buckets and commit the manifest."""
    folder = store.new_folder(manifest["version"])
    write_partitioned(rows, f"{store.root}/{folder}", "parquet", [BUCKET], replace_all=True)
    made = {str(b): {"folder": folder, "rows": n} for b, n in store.bucket_rows(folder).items()}
    store.commit(manifest | {"base": manifest["base"] | made})


def rebuild_current(changes: DataFrame, root: str, keys: Sequence[str], buckets: int) -> None:
    """Make a complete change log the table's next version, whatever it held before.
    ``buckets`` and ``keys`` may differ from those so far."""
    store = Store(changes.sparkSession, root)
    known = store.manifest() or {"version": 0, "applied": {}}
    rows = latest(changes, [*IDENTITY, *keys]).withColumn(BUCKET, bucket_of(keys, buckets))
    fresh = {"version": known["version"] + 1, "keys": list(keys), "buckets": buckets, "base": {}, "deltas": []}
    _new_base(store, rows, known | fresh)


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Delete manifests but the last ``keep`` and every folder that none of these names
    (not folders of versions still being written); returns what was deleted."""
    store = Store(spark, root)
    versions = store.versions()
    kept = [store.manifest(v) for v in versions[-keep:]]
    if not kept:
        return []
    named = {f["folder"] for m in kept for f in [*m["base"].values(), *m["deltas"]]}
    gone = [f"_versions/{v:020d}.json" for v in versions[:-keep]]
    gone += [f for f in (f"data/{n}" for n in store._names("data")) if f not in named and int(f[5:25]) <= versions[-1]]
    for name in gone:
        store.fs.delete(store._path(name), True)
    return gone
