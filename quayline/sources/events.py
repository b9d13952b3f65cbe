"""Object notifications, delivery requests and log lines as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayline.functions.constants import CDN_DEFAULT_FIELDS
from quayline.functions.documents import STRICT_JSON, as_element
from quayline.functions.names import endpoint_part
from quayline.functions.rows import computed_once
from quayline.functions.text import base64_texts, url_decode_plus
from quayline.operators.projections import canonical_order

EVENT_SCHEMA = (
    "source string, `detail-type` string, "
    "detail struct<bucket: struct<name: string>, object: struct<key: string>>"
)
REQUEST_SCHEMA = "requestId string, timestamp bigint, records array<struct<data: string>>"


def object_events(df: DataFrame, json_col: str = "body") -> DataFrame:
    """Notification text -> ``source, detail_type, bucket, raw_key, key``.

    A missing level of the nested detail reads as the empty string; ``key`` is
    URL-decoded, ``raw_key`` is as sent.  The other columns are kept.
    """
    event = F.from_json(F.col(json_col), EVENT_SCHEMA, STRICT_JSON)

    def part(path: str):
        value = F.col("_event")
        for name in path.split("/"):
            value = value[name]
        return F.coalesce(value, F.lit(""))

    parts = {
        "source": part("source"),
        "detail_type": part("detail-type"),
        "bucket": part("detail/bucket/name"),
        "raw_key": part("detail/object/key"),
        "key": url_decode_plus(part("detail/object/key")),
    }
    return computed_once(df.withColumn("_event", event), parts).drop("_event")


def delivery_requests(df: DataFrame, body_col: str = "body", header_id_col: str | None = None) -> DataFrame:
    """Parse delivery requests; adds ``valid_json, request_id, sent_at, payloads``.

    An empty or absent id falls back to the id of the request header, and then
    to the empty string; an invalid body has no id.  ``payloads`` holds
    the decoded text of each record, NULL for a record that is not base64.  A body with anything after
    its document is invalid; the literal ``null`` is an empty request.
    """
    # The body is parsed as the value of a one-field object: text after the end
    # of the body's document then makes the whole text malformed.
    wrapped = F.concat(F.lit('{"r":'), F.col(body_col), F.lit("}"))
    parsed = F.from_json(
        wrapped,
        f"r struct<{_struct_fields(REQUEST_SCHEMA)}>, _malformed string",
        {**STRICT_JSON, "columnNameOfCorruptRecord": "_malformed"},
    )
    header = F.col(header_id_col) if header_id_col else F.lit(None).cast("string")
    request = F.col("_parsed.r")
    # Nor may it close that object: it must also be the only element of an array.
    alone = F.coalesce(F.size(as_element(body_col)) == 1, F.lit(False))
    valid = F.col("_parsed").isNotNull() & F.col("_parsed._malformed").isNull() & F.col("_alone")
    data = F.transform(F.when(valid, request.records), lambda r: F.coalesce(r["data"], F.lit("")))
    return computed_once(
        # Both parses are columns: within the generator each use would parse again.
        df.withColumns({"_parsed": parsed, "_alone": alone}),
        {
            "valid_json": valid,
            "request_id": F.when(
                valid, F.coalesce(F.nullif(request.requestId, F.lit("")), header, F.lit(""))
            ).otherwise(""),
            "sent_at": F.when(valid, request.timestamp),
            "payloads": F.coalesce(base64_texts(data), F.array().cast("array<string>")),
        },
    ).drop("_parsed", "_alone")


def _struct_fields(ddl: str) -> str:
    return ", ".join(f.strip().replace(" ", ": ", 1) for f in ddl.split(", "))


def route(df: DataFrame, path_col: str = "path") -> DataFrame:
    """Add ``org, project, table`` of the request path; NULL when it names none."""
    return df.withColumns({part: endpoint_part(path_col, part) for part in ("org", "project", "table")})


def decode_tsv(df: DataFrame, line_col: str = "line", fields: Sequence[str | None] | None = None) -> DataFrame:
    """Split tab-separated log lines into named string columns.

    Values arrive in the canonical field order whatever the order of ``fields``,
    so position i gets the i-th field of the canonically ordered list.  Missing
    trailing values are NULL; ``extra_values`` counts values beyond the list.
    """
    names = canonical_order(chosen_fields(fields))
    values = F.split(F.col(line_col), "\t", -1)
    return (
        df.withColumn("_values", values)
        .select(
            *[c for c in df.columns if c != line_col],
            *[F.get("_values", F.lit(i)).alias(name) for i, name in enumerate(names)],
            F.greatest(F.size("_values") - len(names), F.lit(0)).alias("extra_values"),
        )
    )


def chosen_fields(fields: Sequence[str | None] | None) -> list[str]:
    """The caller's fields without nulls; none left -> the default fields."""
    named = [f for f in fields or () if f is not None]
    return named or list(CDN_DEFAULT_FIELDS)
