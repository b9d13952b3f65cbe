import time
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from quayline.functions import names, text
from quayline.functions.constants import CDN_DEFAULT_FIELDS, CDN_FIELDS, WHITE_SPACE


def values(spark, inputs, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string")
    return [r[0] for r in df.select("i", make(F.col("v")).alias("out")).orderBy("i").select("out").collect()]


def test_url_decode(spark):
    cases = {
        "a%20b+c.json": "a b c.json",
        "plain/key.csv": "plain/key.csv",
        "50%": "50%",
        "%zz%41": "%zzA",
        "%25+%2B": "% +",
        "%C3%A9": "é",
        "": "",
    }
    assert values(spark, cases, text.url_decode_plus) == list(cases.values())
    assert values(spark, ["a+b%20c"], text.url_decode_path) == ["a+b c"]


def test_url_encode(spark):
    cases = {"a b+c": "a+b%2Bc", "*~_.-": "%2A~_.-", "é/?&=": "%C3%A9%2F%3F%26%3D", "": ""}
    assert values(spark, cases, text.url_encode_query) == list(cases.values())
    assert values(spark, cases, lambda c: text.url_decode_plus(text.url_encode_query(c))) == list(cases)


def test_base64_is_strict(spark):
    cases = {
        "YQ==": b"a", "YWI=": b"ab", "YQ==\n": b"a", "YW\r\nI=": b"ab", "": b"", "YR==": b"a",
        "YQ": None, "Y Q==": None, "YQ= =": None, "###": None, "A===": None, "YQ==YQ==": None, "YW_-": None,
    }
    got = values(spark, cases, text.base64_bytes)
    assert [None if v is None else bytes(v) for v in got] == list(cases.values())


def test_base64_of_a_long_value(spark):
    df = spark.range(1).select(F.base64(F.encode(F.repeat(F.lit("abc"), 200_000), "UTF-8")).alias("v"))
    assert df.select(F.length(text.base64_bytes("v")).alias("n")).first()["n"] == 600_000


def test_trim_space_knows_unicode(spark):
    assert len(set(WHITE_SPACE)) == len(WHITE_SPACE) == 25
    assert values(spark, [WHITE_SPACE + "x y" + WHITE_SPACE, "​x", None], text.trim_space) == ["x y", "​x", None]


def test_invalid_utf8_becomes_a_mark(spark):
    df = spark.sql("select x'61FF62' as b")
    assert df.select(text.bytes_text("b")).first()[0] == "a�b"


def test_format_prefix_pattern(spark):
    keys = ["x.CSV", "x.csv.GZ", "x.txt", "a.NDJSON.gz", "a.jsonl", "a.pq", "a.json.bak"]
    assert values(spark, keys, lambda c: text.matches_format(c, "csv")) == [True, True, False, False, False, False, False]
    assert values(spark, keys, lambda c: text.matches_format(c, "json")) == [False, False, False, True, True, False, False]
    assert values(spark, keys, lambda c: text.matches_format(c, "parquet"))[5]
    for unknown in ("", None, "orc"):
        assert all(values(spark, keys, lambda c: text.matches_format(c, unknown)))  # noqa: B023
    assert values(spark, ["data/x", "Data/x"], lambda c: text.matches_prefix(c, "data/")) == [True, False]
    assert values(spark, ["b/a.csv", "a.CSV"], lambda c: text.matches_pattern(c, r".*\.csv$")) == [True, False]
    assert values(spark, ["a\nb"], lambda c: text.matches_pattern(c, "^b$")) == [False]
    assert values(spark, ["in/x", "x"], lambda c: text.outside_prefixes(c, ["in/"])) == [False, True]


def test_safe_name(spark):
    raw = [
        "harbour_north-cranes_2-lift_log",
        "Harbour-NorthCranes-LiftLog",
        "h?rb#ur-cr*nes-l:ft",
        "-".join(["harbour"] * 9),
        "_-_-_",
    ]
    got = values(spark, raw, names.safe_name)
    assert got == values(spark, raw, names.safe_name)
    assert len(set(got)) == len(raw)
    for name in got[:4]:
        assert 10 <= len(name) <= 40
        assert set(name) <= set("abcdefghijklmnopqrstuvwxyz0123456789-")
        assert name[0] != "-" and name[-1] != "-" and "--" not in name
    assert got[0].startswith("harbour-north-cranes-2-lift-log-")
    assert got[4].startswith("-") and len(got[4]) == 9


def test_base_url(spark):
    cases = {
        "http://localhost:9876/v1/myorg/myproject/tables/logs?transform=firehose": "http://localhost:9876",
        "https://api.example.com/v1/o/p/tables/t": "https://api.example.com",
        "https://api.example.com/other/path": "https://api.example.com/other/path",
        "/v1/o/p": "/v1/o/p",
        "": "",
    }
    assert values(spark, cases, names.base_url) == list(cases.values())


def test_endpoints(spark):
    url = values(spark, ["t"], lambda c: names.delivery_endpoint(F.lit("https://h"), F.lit("o"), F.lit("p"), c))
    assert url == ["https://h/v1/o/p/tables/t?transform=firehose"]
    path = "/v1/my%20org/p+q/tables/logs?columns=a%2Cb&transform=firehose#x"
    for part, want in (("org", "my org"), ("project", "p+q"), ("table", "logs")):
        assert values(spark, [path], lambda c: names.endpoint_part(c, part)) == [want]  # noqa: B023
    assert values(spark, [path, "/v1/o/p/tables/t", None], lambda c: names.query_value(c, "columns")) == ["a,b", None, None]
    paths = [path, "/v1/o/p/tables/t", "/v1/o/p/tables/?transform=firehose", "/v1/o/p/query", "/x/v1/o/p/tables/t?transform=firehose", None]
    assert values(spark, paths, names.is_delivery_path) == [True, False, False, False, False, False]


def test_names_of_tables(spark):
    got = values(spark, ["superstore_sales_data"], lambda c: names.destination_name(F.lit("public"), c))
    assert got == ["public_superstore__sales__data"]
    assert values(spark, ['a"b'], names.quote_identifier) == ['"a""b"']


def test_mask(spark):
    cases = {"0123456789abcdef": "012345...abcdef", "123456789012": "123456789012", "1234567890123": "123456...890123", "": ""}
    assert values(spark, cases, text.mask) == list(cases.values())
    assert values(spark, ["secret", None], lambda c: text.mask(c, "full")) == ["***", None]


def test_first_values_and_counts(spark):
    assert values(spark, ["", None, "x"], lambda c: text.first_set(c, F.lit("env"))) == ["", "env", "x"]
    assert values(spark, ["", None, "x"], lambda c: text.first_non_empty(c, F.lit("env"))) == ["env", "env", "x"]
    counts = ["10", " 7 rows", "-3", "4.9", "x", "", None, "99999999999999999999"]
    assert values(spark, counts, text.lenient_count) == [10, 7, -3, 4, None, None, None, None]
    assert spark.range(1).select(text.lenient_count(F.lit(12.7))).first()[0] == 12


def test_times(spark):
    row = spark.range(1).select(text.millis_timestamp(F.lit(1700000000123)).alias("t")).select("t", text.hour_path("t")).first()
    assert row[0] == datetime(2023, 11, 14, 22, 13, 20, 123000)
    assert row[1] == "2023/11/14/22"


def test_instants_do_not_depend_on_the_machine(spark, monkeypatch):
    monkeypatch.setenv("TZ", "Asia/Tokyo")
    time.tzset()
    try:
        naive, aware = datetime(2024, 1, 1, 5), datetime(2024, 1, 1, 5, tzinfo=timezone(timedelta(hours=2)))
        row = spark.range(1).select(F.unix_seconds(text.instant(naive)), F.unix_seconds(text.instant(aware))).first()
    finally:
        monkeypatch.undo()
        time.tzset()
    assert tuple(row) == (1704085200, 1704078000)


def test_hash(spark):
    a, b = values(spark, ["test-key", "other"], text.sha256_hex)
    assert len(a) == 64 and a != b


def test_field_tables():
    assert len(CDN_FIELDS) == len(set(CDN_FIELDS)) == 69
    assert len(CDN_DEFAULT_FIELDS) == len(set(CDN_DEFAULT_FIELDS)) == 20
    assert [f for f in CDN_FIELDS if f in CDN_DEFAULT_FIELDS] == list(CDN_DEFAULT_FIELDS)
