import json
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayline.functions.documents import field
from quayline.operators import backups, diffs, projections, routing, tables
from quayline.sources.events import decode_tsv
from quayline.functions.constants import CDN_DEFAULT_FIELDS, CDN_FIELDS


def test_tables_come_into_being(spark, tmp_path):
    root = str(tmp_path / "lake")
    assert tables.count_table(spark, root, "t").first()["cnt"] == 0
    assert tables.read_tables(spark, root).count() == 0
    rows = spark.createDataFrame([(1, "a"), (2, None)], "id int, `odd name` string")
    tables.append_table(rows, root, "t", "l1")
    tables.append_table(rows.select("id"), root, "t", "l2", namespace=("acme", "web"))
    assert tables.count_table(spark, root, "t").first()["cnt"] == 4
    assert tables.count_table(spark, root, "t", ("acme", "web")).first()["cnt"] == 2
    assert tables.count_table(spark, root, "other").first()["cnt"] == 0
    typed = tables.read_table(spark, root, "t", "id bigint, `odd name` string")
    assert sorted((r.id, r["odd name"] or "") for r in typed.collect()) == [(1, ""), (1, "a"), (2, ""), (2, "")]


def test_a_repeated_load_replaces_itself(spark, tmp_path):
    root = str(tmp_path / "lake")
    rows = spark.range(10).select("id")
    for _ in range(3):
        tables.append_table(rows, root, "t", "same")
    tables.append_table(rows, root, "t", "other")
    assert tables.count_table(spark, root, "t").first()["cnt"] == 20


def test_count_reads_no_columns_and_prunes_tables(spark, tmp_path):
    root = str(tmp_path / "lake")
    tables.append_table(spark.range(10), root, "t", "l1")
    tables.append_table(spark.range(5), root, "u", "l1")
    plan = tables.count_table(spark, root, "t")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<>" in plan
    assert "(table#" in plan.split("PartitionFilters: [")[1].split("\n")[0]
    one_field = tables.read_table(spark, root, "t", "id bigint")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc:struct<0:bigint" in one_field


def test_names_that_need_escapes(spark, tmp_path):
    root = str(tmp_path / "lake")
    names = ["plain", "with space", "a=b", "50%", "ü", "x*", "{y}", "007", "a.b-c_d"]
    for name in names:
        tables.append_table(spark.range(3), root, name, "l1")
    for name in names:
        assert tables.count_table(spark, root, name).first()["cnt"] == 3, name
    assert {r.table for r in tables.table_counts(spark, root).collect()} == set(names)


def test_only_folders_of_the_table_are_listed(spark, tmp_path):
    root = str(tmp_path / "lake")
    for name in ("t", "u"):
        tables.append_table(spark.range(3), root, name, "l1")
    (tmp_path / "lake/org=default/project=default/table=u/load_id=l1/broken.parquet").write_bytes(b"x")
    assert tables.read_table(spark, root, "t", "id bigint").count() == 3
    assert all("table=t" in f for f in tables.read_table(spark, root, "t").inputFiles())


def test_inferred_columns(spark, tmp_path):
    root = str(tmp_path / "lake")
    assert tables.read_typed(spark, root, "t").columns == []
    docs = ['{"a":1,"b c":{"x y":[1,2]},"n":null}', '{"a":2.5,"t":"x"}', '{"t":7,"z":true}', '[1]', '"text"']
    rows = spark.createDataFrame([(d,) for d in docs], "d string").select(F.parse_json("d").alias("doc"))
    tables.append_table(rows, root, "t", "l1")
    typed = tables.read_typed(spark, root, "t")
    assert dict(typed.dtypes) == {
        "a": "double", "b c": "struct<x y:array<bigint>>", "n": "string", "t": "string", "z": "boolean"
    }
    assert typed.count() == 5
    got = sorted(typed.where("a is not null or t is not null").collect(), key=lambda r: (r.a or 9))
    assert (got[0].a, got[0]["b c"]["x y"], got[1].t, got[2].t, got[2].z) == (1.0, [1, 2], "x", "7", True)


def test_views(spark, tmp_path):
    tables.append_table(spark.range(3), str(tmp_path), "t_view", "l1")
    tables.create_table_view(spark, str(tmp_path), "t_view")
    assert spark.sql("SELECT count(*) AS cnt FROM t_view").first()["cnt"] == 3


def test_retarget_leaves_old_rows(spark, tmp_path):
    root = str(tmp_path / "lake")
    tables.append_table(spark.range(5), root, "old", "l1")
    tables.append_table(spark.range(5), root, "new", "l2")
    counts = {r.table: r.cnt for r in tables.table_counts(spark, root).collect()}
    assert counts == {"old": 5, "new": 5}


@pytest.mark.parametrize("on_conflict", ["string", "variant"])
def test_union_loses_no_rows(spark, on_conflict):
    a = spark.createDataFrame([(1, 2, "x", 1)], "a int, b bigint, c string, only_a int")
    b = spark.createDataFrame([("q", 1.5, 7, [1])], "a string, b double, c int, only_b array<int>")
    c = spark.createDataFrame([((1, "n"), None)], "a struct<x: int, y: string>, c string")
    rows = tables.union_all([a, b, c], on_conflict)
    assert rows.columns == ["a", "b", "c", "only_a", "only_b"] and rows.count() == 3
    kind = T.StringType() if on_conflict == "string" else T.VariantType()
    assert rows.schema["a"].dataType == kind and rows.schema["b"].dataType == T.DoubleType()
    texts = [r[0] for r in rows.select(F.to_json("a") if on_conflict == "variant" else F.col("a")).collect()]
    assert sorted(t.strip('"') for t in texts) == ["1", "q", '{"x":1,"y":"n"}']


def test_merge_schemas_checks_its_mode(spark):
    with pytest.raises(ValueError):
        tables.merge_schemas([spark.range(1)], "drop")


def test_typed_read_of_odd_documents(spark, tmp_path):
    texts = ['{"a":[],"b":{"c":null}}', '{"n":0.5}', "{}"]
    docs = spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("parse_json(t) AS doc")
    tables.append_table(docs, str(tmp_path), "odd", "one")
    rows = tables.read_typed(spark, str(tmp_path), "odd").collect()
    assert sorted(r.n for r in rows if r.n is not None) == [0.5]
    assert [r.a for r in rows if r.a is not None] == [[]] and [r.b.c for r in rows if r.b is not None] == [None]


def test_missing_fields_are_null(spark):
    df = spark.sql("""select parse_json('{"a": {"b": 1}, "x y": "t", "n": "12"}') doc""")
    row = df.select(field("doc", "x y"), field("doc", "n", "int"), field("doc", "zz"), field("doc", "a", "int")).first()
    assert tuple(row) == ("t", 12, None, None)


# ---- projections


def test_canonical_order():
    cases = [
        (list(CDN_FIELDS[:4]), list(CDN_FIELDS[:4])),
        ([CDN_FIELDS[9], CDN_FIELDS[2], CDN_FIELDS[6]], [CDN_FIELDS[2], CDN_FIELDS[6], CDN_FIELDS[9]]),
        (["quay", CDN_FIELDS[5], "berth"], [CDN_FIELDS[5], "quay", "berth"]),
        (list(reversed(CDN_FIELDS)), list(CDN_FIELDS)),
    ]
    for given, want in cases:
        before = list(given)
        assert projections.canonical_order(given) == want
        assert given == before


def test_default_and_chosen_fields(spark):
    line = "\t".join(str(i) for i in range(20))
    df = spark.createDataFrame([(line,)], "line string")
    for none in (None, [], [None]):
        decoded = decode_tsv(df, "line", none)
        assert decoded.columns == [*CDN_DEFAULT_FIELDS, "extra_values"]
        assert decoded.first()["c-country"] == "19"
    wide = decode_tsv(df.select("line"), "line")
    assert projections.select_fields(wide, ["sc-status", None, "timestamp"]).columns == ["timestamp", "sc-status"]
    assert projections.canonical_columns(wide.select("extra_values", "sc-status", "timestamp")).columns == [
        "timestamp", "sc-status", "extra_values"
    ]


def test_uneven_lines(spark):
    df = spark.createDataFrame([("a",), ("a\t\tc",), ("a\tb\tc\td",), ("",)], "line string")
    rows = decode_tsv(df, "line", ["c-ip", "timestamp", "sc-status"]).collect()
    assert [tuple(r) for r in rows] == [("a", None, None, 0), ("a", "", "c", 0), ("a", "b", "c", 1), ("", None, None, 0)]


def test_sampling_grows_with_the_rate(spark):
    df = spark.range(2000)
    kept = set()
    for rate in (1, 10, 50, 99, 100):
        now = {r.id for r in projections.sample_percent(df, "id", rate).collect()}
        assert kept <= now and abs(len(now) / 2000 - rate / 100) < 0.05
        kept = now
    for rate in (0, 101):
        with pytest.raises(ValueError):
            projections.sample_percent(df, "id", rate)


def test_rank_order(spark):
    df = spark.createDataFrame([(1, "zzz"), (2, "b"), (3, "a"), (4, None), (5, "b")], "pos int, v string")
    assert [r.pos for r in projections.order_by_rank(df, "v", ["a", "b"], "pos").collect()] == [3, 2, 5, 1, 4]


def test_sorted_entries(spark):
    df = spark.sql("select map('b', array('2', '1'), 'a', array('x')) as headers")
    rows = projections.sorted_entries(df, "headers").collect()
    assert [(r.name, r.value) for r in rows] == [("a", "x"), ("b", "2"), ("b", "1")]


def test_stringify(spark):
    df = spark.sql("select 1 a, 'x' b, true c, named_struct('p', 1) d, cast(null as int) e, '31/12/2020' f")
    assert tuple(projections.stringify(df).first()) == ("1", "x", "true", '{"p":1}', None, "31/12/2020")


# ---- backup


def test_backup_modes(spark):
    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "i int, failed boolean")
    ids = lambda x: sorted(r.i for r in x.collect())
    for mode, want in (("FailedDataOnly", [1, 3]), ("AllData", [1, 2, 3]), ("anything", [1, 3])):
        good, backup = backups.with_backup(df, F.col("failed"), mode)
        assert ids(good) == [2] and ids(backup) == want


def test_backup_round_trip_replay_and_expiry(spark, tmp_path):
    root = str(tmp_path / "backup")
    schema = "i int, at timestamp, text string"
    rows = spark.createDataFrame(
        [(d, datetime(2024, 1, d, 5, 30, 0, 123456), f"ü{d}") for d in range(1, 11)] + [(0, None, "no time")], schema
    )
    for _ in range(2):
        backups.write_backup(rows, root, "at", "first")
    assert sorted(backups.replay_backup(spark, root, schema).collect(), key=str) == sorted(rows.collect(), key=str)
    assert all(p.name.endswith(".json.gz") for p in tmp_path.rglob("part-*"))
    part = backups.replay_backup(spark, root, schema, "at", datetime(2024, 1, 3, 5, 30), datetime(2024, 1, 5, 5, 30))
    assert sorted(r.i for r in part.collect()) == [3, 4]
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "concat_ws" in plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert backups.expire_backup(spark, root, datetime(2024, 2, 5, 12), days=30) == 5
    assert sorted(r.i for r in backups.replay_backup(spark, root, schema).collect()) == [0, 6, 7, 8, 9, 10]
    assert backups.expire_backup(spark, root, datetime(2024, 2, 5, 12), days=30) == 0


# ---- differences, defaults, routes


def test_table_diff(spark):
    desired = spark.createDataFrame([(1, "a", None), (2, "b", 1), (3, "c", 2), (4, None, 3)], "k int, x string, y int")
    actual = spark.createDataFrame([(1, "a", None), (2, "B", 9), (4, "z", 3), (5, "e", 0)], "k int, x string, y int")
    got = {r.k: (r.change, r.columns) for r in diffs.table_diff(desired, actual, ["k"]).collect()}
    assert got == {
        1: ("same", []), 2: ("changed", ["x", "y"]), 3: ("added", []), 4: ("changed", ["x"]), 5: ("removed", [])
    }


def test_apply_defaults(spark):
    rows = spark.createDataFrame([(1, "", "p"), (2, "mine", None), (3, None, "")], "k int, org string, project string")
    defaults = spark.createDataFrame([(1, "o1", "p1"), (2, "o2", "p2")], "k int, org string, project string")
    got = {r.k: (r.org, r.project) for r in routing.apply_defaults(rows, defaults, ["k"], ["org", "project"]).collect()}
    assert got == {1: ("o1", "p"), 2: ("mine", "p2"), 3: (None, None)}


@pytest.mark.parametrize("broadcast", ["10485760", "-1"])
def test_route_as_of(spark, broadcast):
    at = lambda day: datetime(2024, 1, day)
    routes = spark.createDataFrame([("a", at(2), "old"), ("a", at(5), "new"), ("b", at(1), "b1")], "s string, valid_from timestamp, table string")
    records = spark.createDataFrame(
        [(1, "a", at(1)), (2, "a", at(2)), (3, "a", at(4)), (4, "a", at(5)), (5, "b", at(9)), (6, "c", at(9)), (7, "a", None)],
        "i int, s string, ts timestamp",
    )
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        routed = routing.route_as_of(records, routing.effective_ranges(routes, "s"), "s", "ts")
        got = {r.i: r.table for r in routed.collect()}
        plan = routed._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == {1: None, 2: "old", 3: "old", 4: "new", 5: "b1", 6: None, 7: None}
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("slices", [None, 6])
def test_many_routes_and_a_hot_source(spark, slices):
    """A source with 10,000 routes and most of the records; no record is joined with routes."""
    import random
    from bisect import bisect_right

    rng = random.Random(1)
    starts = {"hot": sorted(rng.sample(range(200_000), 10_000)), "a": [5, 100], "b": []}
    routes = [(s, t, f"{s}{t}") for s, some in starts.items() for t in some]
    records = [(i, "hot" if rng.random() < 0.8 else rng.choice(["a", "b", "c", None]), rng.choice([None, rng.randrange(210_000)])) for i in range(4_000)]
    gaps = routing.effective_ranges(spark.createDataFrame(routes, "s string, valid_from long, table string"), "s")
    gaps = gaps.withColumn("valid_to", F.when(F.col("valid_from") % 7 == 0, F.col("valid_from") + 3).otherwise(F.col("valid_to")))
    df = spark.createDataFrame(records, "i int, s string, ts long").repartition(7)
    routed = routing.route_as_of(df, gaps, "s", "ts", slices=slices)
    got = {r.i: r.table for r in routed.collect()}
    ends = {(r.s, r.valid_from): r.valid_to for r in gaps.collect()}
    for i, s, t in records:
        k = bisect_right(starts.get(s, []), t) - 1 if t is not None else -1
        end = ends[(s, starts[s][k])] if k >= 0 else 0
        assert got[i] == (f"{s}{starts[s][k]}" if k >= 0 and (end is None or t < end) else None)
    plan = routed._jdf.queryExecution().optimizedPlan().toString()
    assert len(got) == 4_000
    assert plan.count("Join") == plan.count("Join LeftOuter") == 1 and "_carried" in plan  # what came before each slice


def test_dump_holds_whole_documents(spark, tmp_path):
    root = str(tmp_path / "lake")
    tables.append_table(spark.sql("select 'ü' as text, array(1,2) as xs"), root, "t", "l1")
    assert [json.loads(r.json) for r in tables.dump_tables(spark, root).collect()] == [{"text": "ü", "xs": [1, 2]}]


def test_evolution_keeps_every_digit(spark, tmp_path):
    """Whole numbers beyond 2^53, wide decimals and exponents beside small fractions."""
    loads = {
        "a": ['{"n": 9007199254740993, "d": 0.25, "m": 9007199254740993, "x.\'y": 1e300}', '{"n": 0.5, "d": 3, "m": 1e300}'],
        "b": ['{"n": 1234567890123456789012, "d": -7.125, "m": 0.5, "x.\'y": 9007199254740993}'],
    }
    for load, texts in loads.items():
        docs = spark.createDataFrame([(t,) for t in texts], "t string").select(F.parse_json("t").alias("doc"))
        tables.append_table(docs, str(tmp_path), "t", load)
    rows = tables.read_typed(spark, str(tmp_path), "t")
    got = [r.asDict() for r in rows.collect()]
    # 22 digits before the point, one behind it.
    assert rows.schema["n"].dataType.simpleString().startswith("decimal(")
    assert {r["n"] for r in got} == {Decimal("9007199254740993"), Decimal("0.5"), Decimal("1234567890123456789012")}
    assert rows.schema["m"].dataType == rows.schema["x.'y"].dataType == T.StringType()
    assert {"9007199254740993", "0.5"} <= {r["m"] for r in got} and "9007199254740993" in {r["x.'y"] for r in got}
    assert sorted(float(r["d"]) for r in got) == [-7.125, 0.25, 3]


def test_merged_numbers_are_wide_enough():
    whole, wide = T.LongType(), T.DecimalType(22, 4)
    assert tables.merged_type(whole, wide) == T.DecimalType(23, 4)
    assert tables.merged_type(T.DecimalType(5, 5), T.DecimalType(9, 0)) == T.DecimalType(14, 5)
    assert tables.merged_type(T.DecimalType(38, 0), T.DecimalType(38, 38)) == T.StringType()
    assert tables.merged_type(wide, T.DoubleType(), "variant") == T.VariantType()
    assert tables.merged_type(whole, T.DoubleType()) == tables.merged_type(T.IntegerType(), T.DoubleType(), exact=True) == T.DoubleType()
    assert tables.merged_type(whole, T.DoubleType(), "variant", exact=True) == T.VariantType()


def test_union_keeps_long_numbers(spark):
    a, b = spark.sql("SELECT 9007199254740993L AS v"), spark.sql("SELECT 0.5D AS v")
    assert {r.v for r in tables.union_all([a, b], exact=True).collect()} == {"9007199254740993", "0.5"}
