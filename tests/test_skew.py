"""Joins on a hot key are split at run time when no side may be broadcast."""

import pytest
from pyspark.sql import functions as F

from quayline.operators import deliveries, routing, tables
from quayline.operators.outcomes import ingest_pending
from quayline.session import setting

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "50000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50000",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
}


@pytest.fixture
def small_limits(spark):
    managers = [setting(spark, k, v) for k, v in SETTINGS.items()]
    for m in managers:
        m.__enter__()
    yield
    for m in reversed(managers):
        m.__exit__(None, None, None)


def rows(spark):
    """200,000 rows, half of them on one key."""
    key = F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 997).cast("string")))
    at = F.timestamp_seconds(F.lit(1700000000) + F.col("id"))
    return spark.range(0, 200_000, 1, 16).select("id", key.alias("k"), at.alias("ts"), F.sha2(F.col("id").cast("string"), 256).alias("body"))


def final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_keys_are_split(spark, small_limits, tmp_path):
    df = rows(spark)
    df.select("k").distinct().write.parquet(str(tmp_path / "keys"))
    keys = spark.read.parquet(str(tmp_path / "keys"))
    defaults = keys.withColumn("body", F.lit("x"))
    seen = keys.where("k like 'k1%'")
    done = seen.withColumn("ok", F.lit(True))
    cases = {
        "defaults": routing.apply_defaults(df, defaults, ["k"], ["body"]),
        "seen": deliveries.drop_seen(df, seen, ["k"]),
        "pending": ingest_pending(df, done, ["k"]),
    }
    for name, joined in cases.items():
        assert "skew=true" in final_plan(joined), name
    assert cases["seen"].count() == df.where("k not like 'k1%'").count()


def test_a_hot_table_is_written_by_many_tasks(spark, small_limits, tmp_path):
    df = rows(spark).select(
        tables.row_document(["id", "body"]).alias("doc"),
        F.lit(None).cast("string").alias("origin"),
        F.lit("o").alias("org"),
        F.lit("p").alias("project"),
        F.when(F.col("k") == "hot", "hot").otherwise(F.concat(F.lit("t"), (F.col("id") % 20).cast("string"))).alias("table"),
    )
    root = str(tmp_path / "lake")
    tables.write_routed(df, root, "l1")
    files = {}
    for path in (tmp_path / "lake").rglob("part-*"):
        files.setdefault(path.parent.parent.name, []).append(path)
    # The id decides both, so odd ids leave ten small tables beside the hot one.
    assert len(files) == 11 and len(files["table=hot"]) > 10
    assert {r.cnt for r in tables.table_counts(spark, root).collect()} == {100_000, 10_000}
