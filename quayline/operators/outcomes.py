"""Did the data arrive: outcomes per object, summaries, growth, reconciliation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from quayline.functions.text import trim_space


def ingest_outcome(events: DataFrame, key: str = "key", seq: str = "seq") -> DataFrame:
    """Outcome of each object from its event log: ``ok, last_type, last_payload``.

    The first ``error`` event ends and fails an object; otherwise its last event
    is the result.  Events without a type (blank lines) say nothing, and an
    object with no other event is ok with a NULL result.  Partial aggregation
    keeps one candidate per object and map task.
    """
    event_type = F.nullif(trim_space(F.coalesce("type", F.lit(""))), F.lit(""))
    failed = event_type == "error"
    told = event_type.isNotNull()
    event = F.struct(event_type.alias("type"), F.col("payload"))
    picked = events.groupBy(key).agg(
        F.min_by(F.when(failed, event), F.when(failed, F.col(seq))).alias("first_error"),
        F.max_by(F.when(told, event), F.when(told, F.col(seq))).alias("last"),
    )
    result = F.coalesce("first_error", "last")
    return picked.select(
        key,
        F.col("first_error").isNull().alias("ok"),
        result["type"].alias("last_type"),
        result["payload"].alias("last_payload"),
    )


def file_results(rows: DataFrame, bad: Column, catalog: DataFrame | None = None, key: str = "key") -> DataFrame:
    """One result per file of a load: ``rows, bad_rows, ok``.

    With the catalog, files that held no row at all appear too, as ok.
    """
    counted = rows.groupBy(key).agg(
        F.count("*").alias("rows"), F.count_if(F.coalesce(bad, F.lit(True))).alias("bad_rows")
    )
    if catalog is not None:
        counted = catalog.select(key).join(counted, key, "left").na.fill(0, ["rows", "bad_rows"])
    return counted.withColumn("ok", F.col("bad_rows") == 0)


def batch_summary(results: DataFrame, ok: str = "ok", sums: Sequence[str] = ()) -> DataFrame:
    """``matched, ok, errors`` of a run, whether it ``failed``, and the sums of
    further columns of the results."""
    return results.agg(
        F.count("*").alias("matched"),
        F.count_if(F.col(ok)).alias("ok"),
        F.count_if(~F.col(ok)).alias("errors"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums],
    ).withColumn("failed", F.col("errors") > 0)


def ingest_pending(catalog: DataFrame, ingest_log: DataFrame, keys: Sequence[str] = ("key", "modified")) -> DataFrame:
    """Objects of the catalog that no successful entry of the log covers."""
    done = ingest_log.where("ok").select(*keys)
    return catalog.join(done, list(keys), "left_anti")


def reconcile(catalog: DataFrame, results: DataFrame, key: str = "key") -> DataFrame:
    """Catalog against results, one row each per key: ``ok, failed, missing``
    (listed, no result) or ``unexpected`` (result, not listed)."""
    c = catalog.select(key, F.lit(True).alias("_listed"))
    r = results.select(key, F.col("ok").alias("_ok"), F.lit(True).alias("_told"))
    state = (
        F.when(F.col("_listed").isNull(), "unexpected")
        .when(F.col("_told").isNull(), "missing")
        .when(F.col("_ok"), "ok")
        .otherwise("failed")
    )
    return c.join(r, key, "full_outer").select(key, state.alias("state"))


def count_growth(before: DataFrame, after: DataFrame, delta: int, key: str = "table") -> DataFrame:
    """Counts per table before and after: ``before, after, grew``.

    ``grew`` asks for at least ``delta`` more rows; a missing table counts 0.
    """
    b = before.select(key, F.col("cnt").alias("before"))
    a = after.select(key, F.col("cnt").alias("after"))
    joined = b.join(a, key, "full_outer").na.fill(0, ["before", "after"])
    return joined.select(key, "before", "after", (F.col("after") >= F.col("before") + delta).alias("grew"))


def expect_min_rows(df: DataFrame, least: int) -> DataFrame:
    """``cnt`` and whether it reaches the expected number of rows."""
    return df.agg(F.count("*").alias("cnt")).withColumn("enough", F.col("cnt") >= least)


def observed_rows(df: DataFrame, name: str = "rows") -> tuple[DataFrame, Observation]:
    """The same rows with a counter: after an action on them, such as their write,
    ``observation.get["cnt"]`` tells their number without another pass."""
    observation = Observation(name)
    return df.observe(observation, F.count(F.lit(1)).alias("cnt")), observation


def key_quality(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``empty``: rows with a NULL or empty key part; ``dup``: keys that occur
    more than once.  Counts per key are combined before the shuffle."""
    blank = F.lit(False)
    for k in keys:
        blank = blank | F.col(k).isNull() | (F.col(k).cast("string") == "")
    per_key = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return per_key.agg(
        F.coalesce(F.sum(F.when(blank, F.col("n"))), F.lit(0)).alias("empty"),
        F.count_if(F.col("n") > 1).alias("dup"),
    )
