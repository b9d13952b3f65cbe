import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quayline.operators.batches import assign_batches
from quayline.operators.running import hot_keys_and_bounds, last_so_far, rate_exceeded, running_sum, running_total, window_counts

START = datetime(2024, 1, 1)


def hot_rows(n=600, seed=1):
    """One key holds about half of all rows, a third of its rows at one instant."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if rng.random() < 0.5 else f"k{rng.randrange(5)}"
        second = 500 if key == "hot" and rng.random() < 0.33 else rng.randrange(2000)
        rows.append((i, key, second, rng.randrange(1, 10)))
    return rows


@pytest.mark.parametrize("slices", [1, 3, 8, 50])
def test_running_sum_with_ties(spark, slices):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "i int, k string, at bigint, v bigint")
    got = {r.i: r.s for r in running_sum(df, ["k"], "at", "v", "s", ties=["i"], slices=slices).collect()}
    peers = {r.i: r.s for r in running_sum(df, ["k"], "at", "v", "s", slices=slices).collect()}
    assert len(got) == len(peers) == len(rows)
    for i, k, at, _ in rows:
        assert got[i] == sum(v for j, k2, a, v in rows if k2 == k and (a, j) <= (at, i))
        assert peers[i] == sum(v for _, k2, a, v in rows if k2 == k and a <= at)


def test_running_sum_without_keys_and_with_nulls(spark):
    df = spark.createDataFrame([(1, None, 5), (2, 10, 1), (3, 20, 2)], "i int, at bigint, v int")
    assert {r.i: r.s for r in running_sum(df, [], "at", "v", "s", ties=["i"], slices=4).collect()} == {1: 5, 2: 6, 3: 8}
    empty = df.where("v > 9")
    assert running_sum(empty, [], "at", "v", "s", ties=["i"]).count() == 0
    null_keys = spark.createDataFrame([(None, 1, 1), (None, 2, 1), ("a", 1, 1)], "k string, at bigint, v int")
    assert sorted(r.s for r in running_sum(null_keys, ["k"], "at", "v", "s", slices=2).collect()) == [1, 1, 2]


def test_slices_split_a_hot_key(spark):
    df = spark.range(9000).select(F.when(F.col("id") < 8000, "hot").otherwise((F.col("id") % 99).cast("string")).alias("k"), "id")
    hot, bounds = hot_keys_and_bounds(df, ["k"], "id", 16)
    assert len(bounds) == 15 and hot == [df.select(F.xxhash64("k")).first()[0]]
    df = df.withColumn("one", F.lit(1))
    summed = running_sum(df, ["k"], "id", "one", "n", ties=["k"], slices=16)
    plan = summed._jdf.queryExecution().executedPlan().toString()
    assert "_slice" in plan.split("Exchange hashpartitioning(")[1].split(")")[0]
    assert summed.agg(F.max("n")).first()[0] == 8000


def test_even_keys_cost_a_plain_window(spark):
    df = spark.range(9000).select((F.col("id") % 300).alias("k"), "id", F.lit(1).alias("one"))
    summed = running_sum(df, ["k"], "id", "one", "n", ties=["id"], slices=16)
    plan = summed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    assert summed.groupBy("k").agg(F.max("n").alias("n")).select("n").distinct().collect()[0].n == 30


def test_running_total(spark):
    rows = [("t", 10, 2, "a"), ("t", 10, 3, "b"), ("t", 5, 1, "c"), ("u", 7, 4, "d")]
    df = spark.createDataFrame(rows, "table string, arrival bigint, ingested bigint, request_id string")
    assert {r.request_id: r.total for r in running_total(df).collect()} == {"a": 3, "b": 6, "c": 1, "d": 4}


@pytest.mark.parametrize("seconds", [1, 60, 300, 5000])
def test_window_counts(spark, seconds):
    rows = [(k, START + timedelta(seconds=s)) for _, k, s, _ in hot_rows(400)]
    df = spark.createDataFrame(rows, "k string, ts timestamp")
    got = {(r.k, r.ts): r.requests for r in window_counts(df, ["k"], "ts", seconds, slices=7).collect()}
    assert len(got) == len(set(rows))
    for k, ts in got:
        low = ts - timedelta(seconds=seconds)
        assert got[(k, ts)] == sum(1 for k2, t in rows if k2 == k and low <= t <= ts)


def test_rate_exceeded_flags_rows(spark):
    rows = [(i, "a", START + timedelta(seconds=60 * i)) for i in range(10)] + [(99, "b", START), (100, None, START), (101, "c", None)]
    df = spark.createDataFrame(rows, "i int, k string, ts timestamp")
    got = {r.i: r.exceeded for r in rate_exceeded(df, ["k"], "ts", limit=3, seconds=180).collect()}
    # Four requests fall into 180 s counting both ends; the fourth is too many.
    assert got == {**{i: i >= 3 for i in range(10)}, 99: False, 100: False, 101: False}


def flushed(rows, max_bytes, seconds):
    """A buffer per stream, record by record: (i, batch, opened)."""
    out, held = [], {}
    for i, stream, at, n in sorted(rows, key=lambda r: (r[2] is not None, r[2] or START, r[0])):
        batch, opened, size = held.get(stream, (-1, None, max_bytes))
        aged = size < max_bytes and at is not None and (opened is None or at >= opened + timedelta(seconds=seconds))
        if size >= max_bytes or aged:
            batch, opened, size = batch + 1, at, 0
        held[stream] = (batch, opened, size + max(n or 0, 0))
        out.append((i, batch, opened))
    return sorted(out)


@pytest.mark.parametrize("max_bytes,seconds,slices", [(100, 120, None), (100, 120, 5), (1, 120, 4), (10**9, 45, 3), (700, 3600, 6)])
def test_assign_batches(spark, max_bytes, seconds, slices):
    rng = random.Random(max_bytes + seconds)
    rows = [
        (i, "hot" if rng.random() < 0.6 else rng.choice(["a", "b", None]), START + timedelta(seconds=rng.randrange(2000)), rng.choice([0, 5, 40, 300, None]))
        for i in range(400)
    ] + [(500 + k, "a", None, 60) for k in range(5)]
    df = spark.createDataFrame(rows, "i int, s string, ts timestamp, n bigint").repartition(5)
    got = assign_batches(df, "s", "ts", "n", max_bytes, seconds, ties=["i"], slices=slices)
    assert got.columns == ["i", "s", "ts", "n", "batch", "opened"]
    assert sorted((r.i, r.batch, r.opened) for r in got.collect()) == flushed(rows, max_bytes, seconds)


def test_batches_of_nothing(spark):
    df = spark.createDataFrame([], "i int, s string, ts timestamp, n bigint")
    assert assign_batches(df, "s", "ts", "n", 10, 10, ties=["i"]).collect() == []


@pytest.mark.parametrize("slices", [None, 1, 4, 9])
def test_last_so_far(spark, slices):
    rng = random.Random(slices or 0)
    rows = [(i, "hot" if rng.random() < 0.7 else rng.choice(["a", "b", None]), rng.choice([None, *range(60)]), rng.choice([None, None, None, i])) for i in range(500)]
    df = spark.createDataFrame(rows, "i int, k string, o bigint, v int").repartition(6)
    got = {r.i: r.last for r in last_so_far(df, ["k"], "o", "v", "last", ["i"], slices).collect()}
    last = {}
    for i, k, _, v in sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0, r[0])):
        last[k] = v if v is not None else last.get(k)
        assert got[i] == last[k]
    assert len(got) == len(rows)
