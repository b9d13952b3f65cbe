"""Names and endpoints as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quayline.functions.constants import DELIVERY_PATH, DELIVERY_TRANSFORM
from quayline.functions.text import col, sha256_hex, url_decode_path, url_decode_plus

NAME_LIMIT = 40
HASH_DIGITS = 8


def safe_name(c: Column | str) -> Column:
    """Lower-case name of letters, digits and single hyphens with a hash suffix.

    At most 40 characters; the suffix is taken from the raw value, so two raw
    names that look alike after cleaning still differ.
    """
    raw = col(c)
    words = F.regexp_replace(F.translate(F.lower(raw), "_", "-"), "[^a-z0-9-]", "")
    single = F.regexp_replace(words, "-+", "-")
    head = F.left(F.ltrim(single, F.lit("-")), F.lit(NAME_LIMIT - HASH_DIGITS - 1))
    return F.concat(F.rtrim(head, F.lit("-")), F.lit("-"), F.left(sha256_hex(raw), F.lit(HASH_DIGITS)))


def base_url(c: Column | str) -> Column:
    """Everything before ``/v1/``; unchanged when it is missing or comes first."""
    url = col(c)
    at = F.instr(url, "/v1/")
    return F.when(at > 1, F.left(url, at - 1)).otherwise(url)


def table_endpoint(base: Column | str, org: Column | str, project: Column | str, table: Column | str) -> Column:
    return F.concat(col(base), F.lit("/v1/"), col(org), F.lit("/"), col(project), F.lit("/tables/"), col(table))


def delivery_endpoint(base, org, project, table, columns: Column | str | None = None) -> Column:
    """Table endpoint with the delivery transform and, optionally, the names of
    the positional columns (an array column, joined by commas)."""
    url = F.concat(table_endpoint(base, org, project, table), F.lit(f"?transform={DELIVERY_TRANSFORM}"))
    if columns is None:
        return url
    return F.concat(url, F.lit("&columns="), F.array_join(col(columns), ","))


def query_value(c: Column | str, name: str) -> Column:
    """Decoded value of a query parameter; NULL when it is absent."""
    url = col(c)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    pairs = F.concat(F.lit("&"), query)
    found = F.regexp_extract(pairs, f"&{name}=([^&]*)", 1)
    return F.when(F.contains(pairs, F.lit(f"&{name}=")), url_decode_plus(found))


def endpoint_part(c: Column | str, part: str) -> Column:
    """``org``, ``project`` or ``table`` of a request path; NULL when unrouted."""
    group = {"org": 1, "project": 2, "table": 3}[part]
    path = url_decode_path(F.substring_index(col(c), "?", 1))
    return F.nullif(F.regexp_extract(path, DELIVERY_PATH, group), F.lit(""))


def is_delivery_path(c: Column | str) -> Column:
    wanted = F.coalesce(query_value(c, "transform"), F.lit("")) == DELIVERY_TRANSFORM
    return F.coalesce(endpoint_part(c, "table").isNotNull() & wanted, F.lit(False))


def destination_name(schema: Column | str, table: Column | str) -> Column:
    """Table name for a replicated source table: underscores doubled, then joined."""
    double = [F.replace(col(c), F.lit("_"), F.lit("__")) for c in (schema, table)]
    return F.concat_ws("_", *double)


def quote_identifier(c: Column | str) -> Column:
    return F.concat(F.lit('"'), F.replace(col(c), F.lit('"'), F.lit('""')), F.lit('"'))
