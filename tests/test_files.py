import gzip
import json
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quayline.functions.documents import document, field, parsed_document, typed_columns
from quayline.operators.outcomes import batch_summary
from quayline.operators.tables import append_table, count_table, document_schema, read_table
from quayline.plans.backfill import backfill
from quayline.plans.inputs import staged_arrays
from quayline.session import setting
from quayline.sources.files import json_whole, read_objects, scan_csv, scan_json, scan_parquet
from quayline.sources.objects import object_catalog

# Five and five rows with unlike keys, about nothing in particular.
EVENTS = [
    {"at": "2031-07-01", "kind": "ferry", "berth": 3, "cargo": "salt", "tons": 40},
    {"at": "2031-07-02", "kind": "barge", "berth": 3, "cargo": "wool", "crew": "four"},
    {"at": "2031-07-03", "kind": "ferry", "berth": 8, "cargo": "coal", "tons": 71},
    {"at": "2031-07-04", "kind": "tug", "berth": 8, "cargo": "none", "tow": "brig"},
    {"at": "2031-07-05", "kind": "ferry", "berth": 1, "cargo": "rope", "tons": 12},
]
LOGS = [{"tide": i % 2, "gauge": f"g{i}", "level": 0.5 + i, "note": None} for i in range(4)] + [{"gauge": "g4", "tons": 7, "moored": True}]
METRICS = "day,quay,depth,ships\n" + "".join(f"2031-08-0{i + 1},q{i},{3.25 * i},{i * i}\n" for i in range(5))


def lines(rows):
    return "".join(json.dumps(r) + "\n" for r in rows)


@pytest.fixture
def store(tmp_path):
    """The three files of the acceptance layout."""
    for folder in ("json", "csv"):
        (tmp_path / "data" / folder).mkdir(parents=True)
    array = "[\n  " + ",\n  ".join(json.dumps(r) for r in EVENTS) + "\n]\n"
    (tmp_path / "data/json/events.json").write_text(array)
    (tmp_path / "data/json/logs.jsonl").write_text(lines(LOGS))
    (tmp_path / "data/csv/metrics.csv").write_text(METRICS)
    return tmp_path


def documents(df):
    return Counter(r[0] for r in df.select(F.to_json("doc")).collect())


def as_counter(rows):
    return Counter(json.dumps(r, separators=(",", ":"), sort_keys=True) for r in rows)


def test_both_json_files_make_one_table(spark, store, tmp_path):
    docs = read_objects(spark, str(store), "json")
    assert documents(docs) == as_counter(EVENTS + LOGS)
    assert read_objects(spark, str(store), "json", prefix="data/json/").count() == 10
    assert read_objects(spark, str(store), "csv", pattern=r".*\.csv$").count() == 5
    lake = str(tmp_path / "lake")
    append_table(docs, lake, "all", "first", origin=F.col("key"))
    assert count_table(spark, lake, "all").first()["cnt"] == 10
    schema = document_schema(read_table(spark, lake, "all")).first()["schema"]
    assert schema.count(":") == 12 and "tons: BIGINT" in schema


def test_typed_read_of_one_table(spark, store):
    docs = read_objects(spark, str(store), "json")
    rows = docs.select(*typed_columns("doc", "kind string, tons bigint, gauge string, missing int")).collect()
    assert sum(r.tons or 0 for r in rows) == 40 + 71 + 12 + 7
    assert sum(r.kind is not None for r in rows) == sum(r.gauge is not None for r in rows) == 5
    assert all(r.missing is None for r in rows)


def test_json_layouts_by_content(spark, tmp_path):
    cases = {
        "lines.json": lines(LOGS),
        "pretty.json": json.dumps(EVENTS[0], indent=2),
        "pretty_array.json": json.dumps(EVENTS, indent=2),
        "one_line_array.json": json.dumps(EVENTS),
        "bom.json": "﻿" + json.dumps(EVENTS[1]),
        "empty.json": "",
        "blank.json": "\n \n",
        "empty_array.json": "[]",
    }
    for name, body in cases.items():
        (tmp_path / name).write_text(body)
    found = scan_json(spark, str(tmp_path)).groupBy("key").count().collect()
    assert {r.key: r["count"] for r in found} == {
        "lines.json": 5, "pretty.json": 1, "pretty_array.json": 5, "one_line_array.json": 5, "bom.json": 1
    }


def test_unparsable_text_is_kept(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a":1}\nnot json\n\n{"a":"q"}\n')
    assert documents(scan_json(spark, str(tmp_path))) == Counter(['{"a":1}', '"not json"', '{"a":"q"}'])


def test_gzip_and_upper_case_names(spark, tmp_path):
    with gzip.open(tmp_path / "a.JSONL.GZ", "wt") as f:
        f.write(lines(LOGS))
    with gzip.open(tmp_path / "b.json.gz", "wt") as f:
        f.write(json.dumps(EVENTS, indent=1))
    with gzip.open(tmp_path / "c.ndjson.gz", "wt") as f:
        f.write(lines(LOGS[:2]))
    (tmp_path / "notes.txt").write_text("no data")
    assert read_objects(spark, str(tmp_path), "json").count() == 12


def test_big_files_are_read_as_lines(spark, tmp_path):
    (tmp_path / "big.json").write_text(lines(LOGS * 20))
    assert scan_json(spark, str(tmp_path), whole_file_limit=100).count() == 100
    (tmp_path / "array.json").write_text("[\n" + ",\n".join(json.dumps(r) for r in LOGS) + "\n]")
    assert scan_json(spark, str(tmp_path), whole_file_limit=100).count() == 105
    assert scan_json(spark, str(tmp_path), layout="whole").count() == 105
    (tmp_path / "document.json").write_text(json.dumps({"rows": list(range(99))}, indent=1))
    with pytest.raises(Exception, match="pass layout='whole'"):
        scan_json(spark, str(tmp_path), whole_file_limit=100).collect()


@pytest.mark.parametrize("limit", [1, 1 << 27])
def test_layout_does_not_depend_on_size(spark, tmp_path, limit):
    (tmp_path / "bad_line.json").write_text('\n{"i":1}\n{"i":2}\nbad line\n{"i":3}\n')
    (tmp_path / "arrays.json").write_text("[1,2]\n[3]\n")
    (tmp_path / "one.json").write_text('[{"i":4},{"i":5}]')
    found = documents(scan_json(spark, str(tmp_path), whole_file_limit=limit))
    assert found == Counter(['{"i":1}', '{"i":2}', '"bad line"', '{"i":3}', "1", "2", "3", '{"i":4}', '{"i":5}'])


@pytest.mark.parametrize("text", ['{"a":1}],[2', '1}, {"x":2', '1, "x":2', "", "[", "1 2"])
def test_no_text_breaks_out_of_a_wrapper(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(parsed_document("t")).first()[0] is None
    assert df.select(F.to_json(document("t"))).first()[0] == json.dumps(text)


def test_csv_text_stays_as_it_is(spark, tmp_path):
    (tmp_path / "a.csv").write_text('zip,version,flag,n\n01234,1.10,TRUE,1e3\n,"a ""b"", c",x,2\n')
    (tmp_path / "b.csv").write_text('n,extra,zip\n7,q,00\n')
    rows = scan_csv(spark, str(tmp_path), schema="zip string, version string, flag string, n double").collect()
    assert Counter(map(tuple, rows)) == Counter([
        ("01234", "1.10", "TRUE", 1000.0), (None, 'a "b", c', "x", 2.0), ("00", None, None, 7.0)
    ])


def test_csv_line_breaks_in_values(spark, tmp_path):
    (tmp_path / "a.csv").write_text('n,t\n1,"x\ny"\n2,z\n')
    rows = scan_csv(spark, str(tmp_path), schema="n int, t string", multi_line=True).collect()
    assert sorted(map(tuple, rows)) == [(1, "x\ny"), (2, "z")]


def test_unknown_format(spark, tmp_path):
    with pytest.raises(ValueError):
        read_objects(spark, str(tmp_path), "orc")


def test_json_whole_takes_lines_of_arrays(spark):
    df = spark.createDataFrame([("k", "[1,2]\n[3]\n")], "key string, body string")
    assert sorted(r[0] for r in json_whole(df).select(F.to_json("doc")).collect()) == ["1", "2", "3"]


def test_odd_documents(spark):
    bodies = {
        "[[1,2],\n[3]]": ["[1,2]", "[3]"],
        '[{"a":1,"a":2},\n5]': ['{"a":2}', "5"],
        '[{"a":1},\n{"a":2}] tail': ['"[{\\"a\\":1},\\n{\\"a\\":2}] tail"'],
        "null": ["null"],
        '{"a":1,\n"a":3}': ['{"a":3}'],
        "no\njson": ['"no\\njson"'],
    }
    df = spark.createDataFrame([(b, b) for b in bodies], "key string, body string")
    got = {}
    for r in json_whole(df).select("key", F.to_json("doc").alias("doc")).collect():
        got.setdefault(r.key, []).append(r.doc)
    assert got == bodies


def test_csv_files_with_unlike_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,y\n1,"q ""2"" z"\n')
    (tmp_path / "b.csv").write_text("y,z\n3,4\n")
    (tmp_path / "empty.csv").write_text("")
    assert documents(scan_csv(spark, str(tmp_path))) == Counter(['{"x":1,"y":"q \\"2\\" z"}', '{"y":3,"z":4}'])
    rows = scan_csv(spark, str(tmp_path), schema="z int, y string").collect()
    assert sorted((r.z, r.y) for r in rows if r.z) == [(4, "3")]
    rows = scan_csv(spark, str(tmp_path), schema="p string, q string", header=False).collect()
    assert len(rows) == 4


def test_csv_files_with_the_same_header(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.csv").write_text('x,y\n1,"q ""2"""\n')
    rows = scan_csv(spark, str(tmp_path), schema="x int, y string", same_header=True, keep_key=True)
    assert sorted((r.key, r.x, r.y) for r in rows.collect()) == [("a.csv", 1, 'q "2"'), ("b.csv", 1, 'q "2"')]
    (tmp_path / "c.csv").write_text("y,x\nq,1\n")
    with pytest.raises(Exception, match="CSV header|FAILED_READ_FILE"):
        scan_csv(spark, str(tmp_path), schema="x int, y string", same_header=True).collect()


def test_parquet_and_pq(spark, tmp_path):
    pd.DataFrame({"a": [1, 2]}).to_parquet(tmp_path / "one.parquet")
    pd.DataFrame({"a": [3], "b": ["x"]}).to_parquet(tmp_path / "two.PQ")
    (tmp_path / "notes.txt").write_text("no data")
    merged = scan_parquet(spark, str(tmp_path), merge_schema=True, keep_key=True)
    assert {(r.key, r.a, r.b) for r in merged.collect()} == {
        ("one.parquet", 1, None), ("one.parquet", 2, None), ("two.PQ", 3, "x")
    }
    assert read_objects(spark, str(tmp_path), "parquet").select(field("doc", "a", "bigint")).count() == 3


def test_catalog_keys(spark, tmp_path):
    names = ["a b/x y+z%41.json", "in/t.json", ".hidden/x.json", "_x.json", "é.csv"]
    for name in names:
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text('{"a":1}\n')
    for root in (str(tmp_path), f"file://{tmp_path}", f"file:{tmp_path}/"):
        catalog = object_catalog(spark, root, internal_prefixes=["in/"]).collect()
        assert {r.key for r in catalog} == {"a b/x y+z%41.json", "é.csv"}
        assert all(r.length == 8 and r.modified is not None for r in catalog)
        assert {r.key for r in scan_json(spark, root).collect()} == {"a b/x y+z%41.json", "in/t.json", "é.csv"}
    assert {r.key for r in object_catalog(spark, str(tmp_path), prefix="a b/").collect()} == {"a b/x y+z%41.json"}


def test_files_are_pruned_before_they_are_read(spark, tmp_path):
    for i in range(6):
        (tmp_path / f"f{i}.jsonl").write_text('{"a":1}\n')
    df = read_objects(spark, str(tmp_path), "json", pattern="f[14]")
    metrics = df._jdf.queryExecution()
    assert df.count() == 2
    plan = metrics.executedPlan().toString()
    assert "FileScan text" in plan and "BatchEvalPython" not in plan
    # A file that cannot be decoded proves that files outside the filter stay closed.
    (tmp_path / "broken.jsonl.gz").write_bytes(b"no gzip")
    assert read_objects(spark, str(tmp_path), "json", pattern="f[14]").count() == 2


def test_prefixes_narrow_the_listing(spark, tmp_path):
    names = ["data/json/a.json", "data/json/ab.jsonl", "data/jsonb.json", "data2/x.json", "we[i]rd{1}/a,b.json", "wei/a.json", "top.json"]
    for name in names:
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text('{"a":1}\n')
    (tmp_path / "data/_own").mkdir()
    (tmp_path / "data/_own/x.json").write_text('{"a":1}\n')
    prefixes = ["", "data/", "data", "data/json", "data/json/", "data/json/a", "data/json/ab", "none/", "none", "we[i]rd{1}/",
                "we[", "w", "/data/", "data//", "../", "data/_own/", "top.json", "data/json/a.json/x"]
    for prefix in prefixes:
        want = {n for n in names if n.startswith(prefix)}
        assert {r.key for r in read_objects(spark, str(tmp_path), "json", prefix=prefix).collect()} == want, prefix
        assert {r.key for r in object_catalog(spark, str(tmp_path), prefix=prefix).collect()} == want, prefix


def test_backfill_reports_every_file(spark, store, tmp_path):
    (store / "data/json/bad.jsonl").write_text('{"a":1}\nnot json\n')
    (store / "data/json/blank.jsonl").write_text("\n \n")
    (store / "data/json/empty.jsonl").write_text("")  # Spark lists no file of zero bytes
    results = backfill(spark, str(store), str(tmp_path / "lake"), "t", "json", "first", prefix="data/")
    got = {r.key: (r.rows, r.bad_rows, r.ok) for r in results.collect()}
    assert got == {
        "data/json/events.json": (5, 0, True),
        "data/json/logs.jsonl": (5, 0, True),
        "data/json/bad.jsonl": (2, 1, False),
        "data/json/blank.jsonl": (0, 0, True),
    }
    summary = batch_summary(results).first()
    assert (summary.matched, summary.ok, summary.errors, summary.failed) == (4, 3, 1, True)
    backfill(spark, str(store), str(tmp_path / "lake"), "t", "json", "first", prefix="data/")
    assert count_table(spark, str(tmp_path / "lake"), "t").first()["cnt"] == 12


LAYOUTS_OF_ANY_SIZE = {
    "cut_line.json": ('{"i":1}\n{"a":1,\n[\n  x ,\n{"i":2}\n', ['{"i":1}', '"{\\"a\\":1,"', '"["', '"x ,"', '{"i":2}']),
    "returns.json": ('{"i":3}\r{"i":4}\r\n\r{"i":5}', ['{"i":3}', '{"i":4}', '{"i":5}']),
    "one_bad.json": ('\n \n  {"a":1,  \n\n', ['"{\\"a\\":1,"']),
    "arrays.json": ('[]\n[6,[7]]\ntext', ["6", "[7]", '"text"']),
}


@pytest.mark.parametrize("limit", [1, 1 << 27])
@pytest.mark.parametrize("name", LAYOUTS_OF_ANY_SIZE)
def test_first_line_decides_at_any_size(spark, tmp_path, name, limit):
    body, want = LAYOUTS_OF_ANY_SIZE[name]
    (tmp_path / name).write_bytes(body.encode())
    with gzip.open(tmp_path / f"{name}.gz", "wb") as f:
        f.write(body.encode())
    (tmp_path / "other.json").write_text('{"other":1}\n' * 3)
    found = documents(scan_json(spark, str(tmp_path), whole_file_limit=limit))
    assert found == Counter(want + want + ['{"other":1}'] * 3)


def test_first_line_decides_over_many_splits(spark, tmp_path):
    (tmp_path / "lines.json").write_text('\n{"i":1}\n' + "bad,\n" * 2000)
    (tmp_path / "malformed.json").write_text("bad\n" + '{"i":1}\n' * 2000)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in before:
            spark.conf.set(k, "1000")
        found = scan_json(spark, str(tmp_path), pattern="lines", whole_file_limit=1)
        assert found.rdd.getNumPartitions() > 4
        assert documents(found) == documents(scan_json(spark, str(tmp_path), pattern="lines")) == Counter({'{"i":1}': 1, '"bad,"': 2000})
        # Small it is one text; big no task may hold it, and its lines are no documents.
        assert scan_json(spark, str(tmp_path), pattern="malformed").count() == 1
        with pytest.raises(Exception, match="pass layout='whole'"):
            scan_json(spark, str(tmp_path), pattern="malformed", whole_file_limit=1).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


ODD = ['a"b\\', "],[", "\\\"", "{", "é\u2028", "", "x" * 700]


def odd_array(n):
    """An array whose strings hold brackets, quotes, commas and escapes; deep elements."""
    return [None, 5, "a,b", [], {}, [[1, [2]], {"k": [{}]}]] + [{"i": i, "s": ODD[i % len(ODD)], "deep": [[i], {"x": [i, {"y": ODD[-i % 7]}]}]} for i in range(n)]


@pytest.mark.parametrize("split", [400, 1 << 27])
@pytest.mark.parametrize("indent", [2, None])
def test_arrays_of_any_size(spark, tmp_path, split, indent):
    items = odd_array(40)
    body = json.dumps(items, indent=indent, ensure_ascii=False) if indent is not None else "[\n" + ",".join(json.dumps(x) + "\n" * (k % 3) for k, x in enumerate(items)) + "]"
    (tmp_path / "a.json").write_text("\ufeff" + body + "\n \n")
    (tmp_path / "b.json").write_text("[\n\n]\n")
    (tmp_path / "c.json").write_text('{"line":1}\n' * 40)
    with gzip.open(tmp_path / "d.json.gz", "wt") as f:
        f.write(body.replace("\n", "\r\n"))
    with setting(spark, "spark.sql.files.maxPartitionBytes", str(split)), setting(spark, "spark.sql.files.openCostInBytes", "100"):
        small = documents(scan_json(spark, str(tmp_path)))
        assert documents(scan_json(spark, str(tmp_path), whole_file_limit=1)) == small
    assert small.total() == 2 * len(items) + 40


@pytest.mark.parametrize("body", ["[\n1,\n]", "[\n1\n", "[\n1\n]\n]", "[\n1\n]\n[2]", "[\n1\n}", "x\n[1]", "[\n1 2\n]", '[\n"a\n]', "[\n,1]", "[\n]\n1", "]\n["])
def test_big_bodies_that_are_no_array(spark, tmp_path, body):
    (tmp_path / "a.json").write_text(body)
    assert scan_json(spark, str(tmp_path)).count() == 1
    with pytest.raises(Exception, match="pass layout='whole'"):
        scan_json(spark, str(tmp_path), whole_file_limit=1).collect()


def test_a_line_longer_than_a_value(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("quayline.sources.files.LINE_LIMIT", 100)
    (tmp_path / "a.json").write_text(json.dumps(odd_array(30)))
    assert documents(scan_json(spark, str(tmp_path), whole_file_limit=1)) == documents(scan_json(spark, str(tmp_path)))


def test_arrays_are_staged_from_partitions_without_rows(spark):
    root = staged_arrays(spark, spark.range(2, numPartitions=4), "few")
    assert documents(scan_json(spark, root)) == as_counter([{"id": 0}, {"id": 1}])


@pytest.mark.parametrize("packed", [False, True])
def test_files_that_are_looked_into_give_the_same_rows(spark, tmp_path, packed):
    bodies = [body for body, _ in LAYOUTS_OF_ANY_SIZE.values()] + ["﻿ \r\n\x0b\n{\"i\":1}\r\n\r\nbad\n", "\n  \n", "﻿\n\x0b\n﻿\n{}\n", "[1,2]\r[3]\r", json.dumps(odd_array(9), indent=1)]
    for k, body in enumerate(bodies):
        with (gzip.open(tmp_path / f"{k}.json.gz", "wb") if packed else open(tmp_path / f"{k}.json", "wb")) as f:
            f.write(body.encode())

    def rows(**options):
        return Counter(map(tuple, scan_json(spark, str(tmp_path), **options).select("key", F.to_json("doc")).collect()))

    held = rows()
    assert rows(looked_into=1) == held
    assert len({key for key, _ in held}) > 5


def test_lines_of_files_that_are_looked_into_are_split(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"i":1}\n' * 2000)
    with setting(spark, "spark.sql.files.maxPartitionBytes", "1000"), setting(spark, "spark.sql.files.openCostInBytes", "1000"):
        found = scan_json(spark, str(tmp_path), looked_into=1000).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in found) == 2000 and max(r["count"] for r in found) < 200
