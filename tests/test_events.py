import json

import pytest
from pyspark.sql import functions as F

from quayline.operators import filters, outcomes
from quayline.sources.events import object_events


def notification(bucket="b", key="k.json", source="aws.s3", kind="Object Created"):
    return json.dumps({"source": source, "detail-type": kind, "detail": {"bucket": {"name": bucket}, "object": {"key": key}}})


def events(spark, bodies):
    return object_events(spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, body string"))


@pytest.mark.parametrize("body", ["{}", '{"detail":{}}', '{"detail":null}', "not json", None, notification(key=""), notification(bucket="")])
def test_incomplete_events_are_invalid(spark, body):
    row = filters.classify_events(events(spark, [body])).first()
    assert (row.status, row.reason) == ("skipped", "invalid event")
    assert filters.valid_events(events(spark, [body])).count() == 0


def test_first_failing_check_wins(spark):
    cases = [
        ("in/a%20b+c.json", "in/a b c.json", None),
        ("in/x.CSV", "in/x.CSV", "format mismatch"),
        ("out/x.txt", "out/x.txt", "prefix mismatch"),
        ("in/zzz.json", "in/zzz.json", "pattern mismatch"),
        ("in/own/a.json", "in/own/a.json", "prefix mismatch"),
    ]
    judged = filters.classify_events(
        events(spark, [notification(key=c[0]) for c in cases]), "in/", "json", "[ax]", internal_prefixes=["in/own/"]
    )
    assert [(r.key, r.reason) for r in judged.orderBy("i").collect()] == [c[1:] for c in cases]
    histogram = {(r.status, r.reason): r.events for r in filters.event_summary(judged).collect()}
    assert histogram[("skipped", "prefix mismatch")] == 2 and histogram[("ingested", None)] == 1


def test_format_is_optional(spark):
    for fmt in ("", None, "orc"):
        assert filters.classify_events(events(spark, [notification(key="x.bin")]), fmt=fmt).first().reason is None
    assert filters.classify_events(events(spark, [notification(key="x.CSV")]), fmt="csv").first().reason is None


def test_match_events(spark):
    bodies = [
        notification(key="p/a"), notification(key="q/a"), notification(bucket="other", key="p/a"),
        notification(key="p/b", kind="Object Deleted"), notification(key="p/c", source="else"),
    ]
    got = filters.match_events(events(spark, bodies), buckets=["b"], key_prefix="p/")
    assert [r.i for r in got.collect()] == [0]
    assert filters.match_events(events(spark, bodies)).count() == 3


def log(spark, rows):
    return spark.createDataFrame(rows, "key string, seq int, type string, payload string")


def test_ingest_outcome(spark):
    rows = [
        ("good", 1, "started", "s"), ("good", 2, "progress", "p"), ("good", 3, "done", "d"),
        ("bad", 1, "started", "s"), ("bad", 2, "error", "e1"), ("bad", 3, "done", "d"), ("bad", 4, "error", "e2"),
        ("blank", 1, "", None), ("blank", 2, None, None),
        ("tail", 1, "done", "d"), ("tail", 2, " ", None),
    ]
    got = {r.key: (r.ok, r.last_type, r.last_payload) for r in outcomes.ingest_outcome(log(spark, rows)).collect()}
    assert got == {
        "good": (True, "done", "d"), "bad": (False, "error", "e1"), "blank": (True, None, None), "tail": (True, "done", "d")
    }


def test_summary_of_nothing(spark):
    row = outcomes.batch_summary(spark.createDataFrame([], "key string, ok boolean")).first()
    assert (row.matched, row.ok, row.errors, row.failed) == (0, 0, 0, False)


def test_pending_and_reconcile(spark):
    catalog = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 4)], "key string, modified int")
    results = spark.createDataFrame([("a", 1, True), ("b", 1, True), ("c", 3, False), ("x", 9, True)], "key string, modified int, ok boolean")
    assert {r.key for r in outcomes.ingest_pending(catalog, results).collect()} == {"b", "c", "d"}
    states = {r.key: r.state for r in outcomes.reconcile(catalog, results).collect()}
    assert states == {"a": "ok", "b": "ok", "c": "failed", "d": "missing", "x": "unexpected"}


def test_growth_and_quality(spark):
    before = spark.createDataFrame([("a", 10), ("gone", 3)], "table string, cnt bigint")
    after = spark.createDataFrame([("a", 15), ("new", 5)], "table string, cnt bigint")
    got = {r.table: (r.before, r.after, r.grew) for r in outcomes.count_growth(before, after, 5).collect()}
    assert got == {"a": (10, 15, True), "gone": (3, 0, False), "new": (0, 5, True)}
    names = spark.createDataFrame([("a",), ("a",), ("b",), ("",), (None,)], "name string")
    row = outcomes.key_quality(names, ["name"]).first()
    assert (row.empty, row.dup) == (2, 1)
    observed, observation = outcomes.observed_rows(names)
    observed.write.format("noop").mode("overwrite").save()
    assert observation.get["cnt"] == 5
    assert outcomes.expect_min_rows(names, 5).first().enough
    assert not outcomes.expect_min_rows(names.where(F.lit(False)), 1).first().enough
