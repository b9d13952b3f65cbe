import base64
import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quayline.operators import deliveries as d
from quayline.operators.tables import dump_tables, table_counts, write_routed
from quayline.sources.events import delivery_requests
from quayline.streaming.deliveries import classified_requests, delivered_rows

PATH = "/v1/org/project/tables/waf_logs?transform=firehose"


def b64(text):
    return base64.b64encode(text.encode()).decode()


def body(request_id, *texts, data=None):
    records = [{"data": x} for x in (data or [b64(t) for t in texts])]
    return json.dumps({"requestId": request_id, "timestamp": 1700000000000, "records": records})


def envelopes(spark, rows):
    full = []
    for i, row in enumerate(rows):
        full.append((i, row.get("method", "POST"), row.get("path", PATH), row.get("access_key"), row.get("header"), row.get("body")))
    df = spark.createDataFrame(full, "i int, method string, path string, access_key string, header_request_id string, body string")
    return df.withColumn("arrived", F.timestamp_seconds(F.lit(1700000000) + F.col("i")))


def parsed(spark, rows):
    return delivery_requests(envelopes(spark, rows), "body", "header_request_id")


def answers(spark, rows, key=None):
    return [(r.status, r.error) for r in d.classify_deliveries(parsed(spark, rows), key).orderBy("i").collect()]


def test_known_request(spark):
    request = '{"requestId":"test-001","timestamp":1700000000000,"records":[{"data":"eyJ0aW1lc3RhbXAiOjEyMzR9"}]}'
    rows = d.explode_records(parsed(spark, [{"body": request}])).collect()
    assert [(r.request_id, r.rec_pos, r.line_pos, r.line) for r in rows] == [("test-001", 0, 0, '{"timestamp":1234}')]


def test_answers_in_order(spark):
    bad_json = "{"
    bad_data = body("r", data=["###"])
    rows = [
        {"method": "GET", "path": "/nothing", "body": bad_json},
        {"path": "/nothing", "body": bad_json},
        {"path": "/v1/org/project/tables/waf_logs", "body": bad_json},
        {"body": None, "access_key": "wrong"},
        {"body": bad_json, "access_key": "wrong"},
        {"body": bad_json, "access_key": "key"},
        {"body": bad_data, "access_key": "key"},
        {"body": body("r", "a"), "access_key": "key"},
        {"body": body("r", "a"), "access_key": None},
        {"body": body("r"), "access_key": "key"},
    ]
    codes = [405, 404, 404, 400, 403, 400, 500, 200, 403, 200]
    got = answers(spark, rows, "key")
    assert [c for c, _ in got] == codes
    assert got[3][1] == "failed to read body" and got[5][1] == "invalid JSON body" and got[7][1] is None
    assert [c for c, _ in answers(spark, rows)][3:] == [400, 400, 400, 500, 200, 200, 200]
    assert answers(spark, rows[8:9], "") == [(200, None)]


@pytest.mark.parametrize(
    ("text", "valid"),
    [
        ("{}", True), ("null", True), ('{"records":null}', True), ('{"other":1}', True), (' {"requestId":"a"} ', True),
        ("", False), ("[]", False), ('"x"', False), ("1", False), ('{"requestId":"a"', False), ("{'requestId':'a'}", False),
        ('{"requestId":"a"} {}', False), ('{"timestamp":"x"}', False), ('{"records":{}}', False),
    ],
)
def test_json_bodies(spark, text, valid):
    row = parsed(spark, [{"body": text, "header": "h"}]).first()
    assert row.valid_json is valid
    assert row.payloads is not None
    if not valid:
        assert row.request_id == "" and row.payloads == []


def test_request_ids(spark):
    rows = [{"body": body("own"), "header": "head"}, {"body": body(""), "header": "head"}, {"body": "{}"}]
    assert [r.request_id for r in parsed(spark, rows).orderBy("i").collect()] == ["own", "head", ""]


def test_lines_of_records(spark):
    request = body("r", "a\n\n  b \n", " ", "　c \r\nd")
    rows = d.explode_records(parsed(spark, [{"body": request}])).collect()
    assert [(r.rec_pos, r.line_pos, r.line) for r in rows] == [(0, 0, "a"), (0, 1, "b"), (2, 0, "c"), (2, 1, "d")]
    stats = d.delivery_stats(parsed(spark, [{"body": request}, {"body": body("e")}])).collect()
    assert [(r.records_in_batch, r.ingested) for r in stats] == [(3, 4), (0, 0)]


def test_first_delivery_wins(spark):
    rows = [
        {"body": body("a", "1")}, {"body": body("a", "2"), "path": PATH.replace("waf_logs", "other")},
        {"body": body("", "3")}, {"body": body("", "4")}, {"body": body("b", "5")},
    ]
    df = parsed(spark, rows)
    assert {r.i for r in d.dedup_requests(df, ["i"]).collect()} == {0, 2, 4}
    assert {r.i for r in d.dedup_requests(df, ["i"], keep_anonymous=True).collect()} == {0, 2, 3, 4}
    assert {r.i for r in d.dedup_requests(df, ["i"], keys=("path", "request_id")).collect()} == {0, 1, 2, 4}
    once = d.dedup_requests(df, ["i"])
    assert sorted(once.select("i").collect()) == sorted(d.dedup_requests(once, ["i"]).select("i").collect())
    seen = spark.createDataFrame([("a",), ("a",)], "request_id string")
    assert {r.i for r in d.drop_seen(once, seen).collect()} == {2, 4}


def test_first_delivery_is_picked_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).cast("string").alias("request_id"), "id")
    plan = d.dedup_requests(df, ["id"])._jdf.queryExecution().executedPlan().toString()
    before_shuffle = plan[plan.index("Exchange hashpartitioning"):]
    assert "WindowGroupLimit" in before_shuffle and "Partial" in before_shuffle


def test_routed_rows(spark, tmp_path):
    rows = [
        {"body": body("1", '{"a":1}\n{"a":2}')},
        {"body": body("2", "no json"), "path": "/v1/org/project/tables/007?transform=firehose"},
        {"body": body("3", data=[b64('{"a":3}'), "###"])},
    ]
    root = str(tmp_path / "lake")
    write_routed(delivered_rows(classified_requests(envelopes(spark, rows))), root, "x")
    counts = {(r.org, r.project, r.table): r.cnt for r in table_counts(spark, root).collect()}
    assert counts == {("org", "project", "waf_logs"): 2, ("org", "project", "007"): 1}
    assert sorted((r.table, r.json) for r in dump_tables(spark, root).collect()) == [
        ("007", '"no json"'), ("waf_logs", '{"a":1}'), ("waf_logs", '{"a":2}')
    ]


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="ab \t\n\r　", max_size=20), max_size=5))
def test_rows_are_the_non_blank_lines(spark, texts):
    want = [line.strip() for t in texts for line in t.split("\n") if line.strip()]
    df = parsed(spark, [{"body": body("r", *texts)}])
    rows = d.explode_records(df).orderBy("rec_pos", "line_pos").collect()
    assert [r.line for r in rows] == want
    assert d.delivery_stats(df).first().ingested == len(want)


def test_bodies_that_close_their_wrapper_are_malformed(spark):
    bodies = ['{"requestId":"a","records":[]}} x', '{"requestId":"a"},"r":{"requestId":"b"}', '{"requestId":"a"}],[2']
    assert answers(spark, [{"body": b} for b in bodies]) == [(400, "invalid JSON body")] * 3
    assert answers(spark, [{"body": "null"}, {"body": '{"requestId":"a","records":[]}'}]) == [(200, None)] * 2


def test_a_body_is_parsed_as_a_document_once(spark):
    from quayline.sources.events import delivery_requests

    df = spark.createDataFrame([('{"requestId":"a","timestamp":1,"records":[]}',)], "body string")
    plan = delivery_requests(df, "body")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(ArrayType(VariantType") == 1


def test_big_targets_are_written_without_sorting(spark, tmp_path, monkeypatch):
    from pyspark.sql.readwriter import DataFrameWriter

    from quayline.operators.writes import write_partitioned

    name, save, open_files = "spark.sql.maxConcurrentOutputFileWriters", DataFrameWriter.save, []

    def noted(writer, *args, **options):
        open_files.append(int(spark.conf.get(name)))
        return save(writer, *args, **options)

    monkeypatch.setattr(DataFrameWriter, "save", noted)
    before = spark.conf.get(name)
    # More targets than are held open, and fewer.
    for n in (30, 2):
        rows = spark.range(4000, numPartitions=4).selectExpr("id", f"id % {n} as target")
        write_partitioned(rows, str(tmp_path / str(n)), "parquet", ["target"])
        found = spark.read.parquet(str(tmp_path / str(n))).select("id", "target").collect()
        assert sorted(map(tuple, found)) == [(k, k % n) for k in range(4000)]
    assert min(open_files) > 1 and spark.conf.get(name) == before
