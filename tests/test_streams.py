import json
from datetime import datetime, timedelta

import pytest

from quayline.operators.backups import replay_backup
from quayline.operators.tables import count_table, dump_tables, table_counts
from quayline.plans.stream_queries import ENVELOPE_SCHEMA
from quayline.sources.changes import cdc_changes
from quayline.streaming import versions
from quayline.streaming.changes import cdc_stream
from quayline.streaming.versions import read_current
from quayline.streaming.deliveries import dedup_stream, delivery_stream
from quayline.streaming.rates import end_marker, rate_exceeded_stream
from quayline.streaming.ingest import buffer_trigger, drain, ingest_stream, stream_objects
from test_changes import SCHEMA, found, random_log, state
from test_deliveries import PATH, b64, body


def test_new_files_are_taken_once(spark, tmp_path):
    files, lake, checkpoint = (str(tmp_path / x) for x in ("in", "lake", "checkpoint"))
    folder = tmp_path / "in" / "data"
    folder.mkdir(parents=True)

    def run():
        stream = stream_objects(spark, files, "json", prefix="data/", pattern="[^x][.](nd)?json", max_bytes=40)
        drain(ingest_stream(stream, lake, "t", checkpoint))
        return count_table(spark, lake, "t").first()["cnt"]

    (folder / "a.json").write_text(json.dumps([{"i": 1}, {"i": 2}], indent=1))
    (folder / "b.jsonl").write_text('{"i":3}\n\n{"i":4}\n')
    (folder / "c.csv").write_text("i\n9\n")
    (folder / "x.jsonl").write_text('{"i":9}\n')
    assert run() == 4
    assert run() == 4
    (folder / "d.ndjson").write_text('{"i":5}\n')
    assert run() == 5


def test_csv_and_parquet_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text('x,y\n1,"a ""b"""\n')
    (tmp_path / "in" / "b.csv").write_text("y,z\n3,4\n")
    spark.range(3).coalesce(1).write.parquet(str(tmp_path / "in" / "p"))
    lake = str(tmp_path / "lake")
    for fmt, schema in (("csv", None), ("parquet", "id bigint")):
        stream = stream_objects(spark, str(tmp_path / "in"), fmt, schema=schema)
        drain(ingest_stream(stream, lake, fmt, str(tmp_path / f"checkpoint-{fmt}")))
    rows = sorted((r.table, r.json) for r in dump_tables(spark, lake).collect())
    assert rows == [
        ("csv", '{"x":1,"y":"a \\"b\\""}'), ("csv", '{"y":3,"z":4}'),
        ("parquet", '{"id":0}'), ("parquet", '{"id":1}'), ("parquet", '{"id":2}'),
    ]


def test_only_objects_after_the_start(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"i":1}\n')
    for since, rows in ((datetime.now() + timedelta(days=1), 0), (datetime.now() - timedelta(days=1), 1)):
        lake = str(tmp_path / f"lake{rows}")
        stream = stream_objects(spark, str(tmp_path / "in"), "json", since=since)
        drain(ingest_stream(stream, lake, "t", str(tmp_path / f"checkpoint{rows}")))
        assert count_table(spark, lake, "t").first()["cnt"] == rows


def test_buffer_bounds():
    assert buffer_trigger() == (5 * 1024 * 1024, {"processingTime": "300 seconds"})
    assert buffer_trigger(64, 900)[0] == 64 * 1024 * 1024
    for size, seconds in ((0, 60), (65, 60), (1, 59), (1, 901)):
        with pytest.raises(ValueError):
            buffer_trigger(size, seconds)


def envelope(**parts):
    row = {"method": "POST", "path": PATH, "access_key": "key", "arrived": "2024-01-01T10:00:00.123456Z"}
    return json.dumps({**row, **parts})


def test_delivery_stream(spark, tmp_path):
    source, lake, backup, checkpoint = (str(tmp_path / x) for x in ("in", "lake", "backup", "checkpoint"))
    (tmp_path / "in").mkdir()

    def run(name, *rows, mode="FailedDataOnly"):
        (tmp_path / "in" / name).write_text("\n".join(rows) + "\n")
        stream = spark.readStream.schema(ENVELOPE_SCHEMA).json(source)
        drain(delivery_stream(stream, lake, backup, checkpoint, "key", mode))

    bad = body("r3", data=[b64('{"lost":1}'), "###"])
    run("1.json", envelope(body=body("r1", '{"a":1}\n{"a":2}')), envelope(body=body("r1", '{"a":1}\n{"a":2}')), envelope(body=bad))
    run("2.json", envelope(body=body("r1", '{"a":1}')), envelope(body=body("r2", "text")), envelope(body=body("", "one")))
    run("3.json", envelope(body=body("", "two")), envelope(body=body("r3", '{"a":3}')), envelope(access_key="no", body=body("r9", "x")))
    assert {r.table: r.cnt for r in table_counts(spark, lake).collect()} == {"waf_logs": 5}
    assert sorted(r.json for r in dump_tables(spark, lake).collect()) == sorted(['{"a":1}', '{"a":2}', '"text"', '"one"', '{"a":3}'])
    failed = replay_backup(spark, backup, ENVELOPE_SCHEMA + ", status int, error string", "arrived").collect()
    assert sorted((r.status, r.error) for r in failed) == [(403, "invalid access key"), (500, "base64 decode")]
    assert {r.body for r in failed} == {bad, body("r9", "x")}
    assert failed[0].arrived == datetime(2024, 1, 1, 10, 0, 0, 123456)


def test_a_batch_writes_one_file_per_hour_and_table(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(4):  # many tasks, each with rows of both hours
        rows = [envelope(method="GET", body=str(n), arrived=f"2024-01-01T0{n % 2}:00:00Z") for n in range(20)]
        rows += [envelope(body=body(f"{i}-{n}", '{"a":1}')) for n in range(20)]
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(rows))
    stream = spark.readStream.schema(ENVELOPE_SCHEMA).json(str(tmp_path / "in"))
    drain(delivery_stream(stream, str(tmp_path / "lake"), str(tmp_path / "backup"), str(tmp_path / "c")))
    assert len(list((tmp_path / "backup").rglob("part-*"))) == 2
    assert len(list((tmp_path / "lake").rglob("part-*"))) == 1
    assert spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled") == "true"


def test_all_data_backup(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [envelope(body=body("r1", "a"))] * 3 + [envelope(method="GET", body="x")] * 2
    (tmp_path / "in" / "1.json").write_text("\n".join(rows) + "\n")
    stream = spark.readStream.schema(ENVELOPE_SCHEMA).json(str(tmp_path / "in"))
    backup = str(tmp_path / "backup")
    drain(delivery_stream(stream, str(tmp_path / "lake"), backup, str(tmp_path / "c"), backup_mode="AllData", horizon="1 day"))
    assert replay_backup(spark, backup, ENVELOPE_SCHEMA).count() == 5  # every request, also repeated ones
    assert count_table(spark, str(tmp_path / "lake"), "waf_logs").first()["cnt"] == 1


def test_backup_goes_on_without_its_table(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text(envelope(body=body("r1", "a")) + "\n")
    (tmp_path / "lake").write_text("a file where the tables should be")
    stream = spark.readStream.schema(ENVELOPE_SCHEMA).json(str(tmp_path / "in"))
    queries = delivery_stream(stream, str(tmp_path / "lake"), str(tmp_path / "backup"), str(tmp_path / "c"), backup_mode="AllData")
    queries.queries[1].awaitTermination(60)
    with pytest.raises(Exception):  # noqa: B017  whatever the store says
        drain(queries)
    assert replay_backup(spark, str(tmp_path / "backup"), ENVELOPE_SCHEMA).count() == 1


def test_dedup_needs_both_or_none(spark):
    with pytest.raises(ValueError):
        dedup_stream(spark.range(1), ["id"], arrived="ts")


def test_dedup_within_horizon(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, rows in (("1", [("a", 0), ("a", 60), ("b", 0)]), ("2", [("a", 120), ("c", 0)])):
        (tmp_path / "in" / f"{name}.json").write_text(
            "\n".join(json.dumps({"request_id": k, "at": f"2024-01-01T00:{s // 60:02d}:00Z"}) for k, s in rows)
        )
    stream = spark.readStream.schema("request_id string, at timestamp").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    query = (
        dedup_stream(stream, arrived="at", horizon="1 hour").writeStream.trigger(availableNow=True)
        .option("checkpointLocation", str(tmp_path / "c")).format("parquet").start(str(tmp_path / "out"))
    )
    drain(query)
    assert sorted(r.request_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c"]


def test_change_stream_equals_batch(spark, tmp_path):
    log = random_log()
    df = spark.createDataFrame(log, SCHEMA)
    df.repartition(5).write.json(str(tmp_path / "in"))
    stream = cdc_changes(spark, str(tmp_path / "in"), SCHEMA, max_bytes=10_000)
    current = str(tmp_path / "current")
    for _ in range(2):
        drain(cdc_stream(stream, str(tmp_path / "log"), current, ["id"], str(tmp_path / "c"), buckets=3))
    assert found(read_current(spark, current, df.schema)) == state(log)
    assert count_table(spark, str(tmp_path / "log"), "public_superstore__sales__data").first()["cnt"] == len(log)


def test_change_stream_goes_on_after_a_kill(spark, tmp_path, monkeypatch):
    """The driver dies after a batch's files were written and before they were committed."""
    log = random_log()
    df = spark.createDataFrame(log, SCHEMA)
    df.repartition(5).write.json(str(tmp_path / "in"))
    current = str(tmp_path / "current")

    def run():
        stream = cdc_changes(spark, str(tmp_path / "in"), SCHEMA, max_bytes=10_000)
        drain(cdc_stream(stream, str(tmp_path / "log"), current, ["id"], str(tmp_path / "c"), buckets=3))

    commit, calls = versions.Store.commit, []

    def sometimes(self, manifest):
        calls.append(manifest["version"])
        if len(calls) in (2, 4):
            raise RuntimeError("killed")
        commit(self, manifest)

    monkeypatch.setattr(versions.Store, "commit", sometimes)
    for _ in range(2):
        with pytest.raises(Exception, match="killed"):
            run()
    run()
    assert found(read_current(spark, current, df.schema)) == state(log)
    assert count_table(spark, str(tmp_path / "log"), "public_superstore__sales__data").first()["cnt"] == len(log)


def test_end_marker_closes_the_last_windows(spark, tmp_path):
    """The last rows of a stream are over the limit only where the marker follows."""
    start = datetime(2024, 1, 1)
    rows = spark.createDataFrame([("a", start + timedelta(seconds=k)) for k in range(6)] + [("b", start)], "user string, at timestamp")
    counts = []
    for name, marker in (("with", end_marker(rows, "at")), ("without", rows.limit(0))):
        folder, out = str(tmp_path / name), str(tmp_path / f"{name}-out")
        rows.write.parquet(folder)
        marker.write.mode("append").parquet(folder)
        over = rate_exceeded_stream(spark.readStream.schema(rows.schema).parquet(folder), "user", "at", 5)
        query = over.writeStream.option("checkpointLocation", str(tmp_path / f"{name}-cp")).trigger(availableNow=True).format("parquet")
        drain(query.start(out))
        counts.append([tuple(r) for r in spark.read.schema(over.schema).parquet(out).select("user", "requests").collect()])
    assert counts == [[("a", 6)] * 5, []]
    assert end_marker(rows.limit(0), "at").first().asDict() == {"user": None, "at": None}
