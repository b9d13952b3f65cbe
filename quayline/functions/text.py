"""Text and key expressions.  All are built-in Catalyst expressions."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from quayline.functions.constants import FORMAT_EXTENSIONS, WHITE_SPACE


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_space(c: Column | str) -> Column:
    """Strip every Unicode white-space character from both ends (linear time)."""
    return F.btrim(col(c), F.lit(WHITE_SPACE))


def url_decode_plus(c: Column | str) -> Column:
    """Decode ``%XX`` and ``+``.  A ``%`` without two hex digits stays as it is."""
    return F.try_url_decode(F.regexp_replace(col(c), "%(?![0-9A-Fa-f]{2})", "%25"))


def url_decode_path(c: Column | str) -> Column:
    """Like :func:`url_decode_plus`, but a literal ``+`` stays a plus."""
    return url_decode_plus(F.replace(col(c), F.lit("+"), F.lit("%2B")))


def url_encode_query(c: Column | str) -> Column:
    """Encode a query value: blanks as ``+``, all but letters, digits and ``_.-~``
    as ``%XX``.  (Java keeps ``*`` and encodes ``~``.)"""
    encoded = F.replace(F.url_encode(col(c)), F.lit("*"), F.lit("%2A"))
    return F.replace(encoded, F.lit("%7E"), F.lit("~"))


def ends_with_any(c: Column | str, suffixes: Iterable[str]) -> Column:
    """True if the lower-cased value ends with any suffix; no suffixes -> true."""
    lowered = F.lower(col(c))
    tests = [F.endswith(lowered, F.lit(s)) for s in suffixes]
    return any_of(tests) if tests else F.lit(True)


def contains_any(c: Column | str, needles: Iterable[str]) -> Column:
    """True if the lower-cased value contains any needle; NULL counts as empty."""
    lowered = F.lower(F.coalesce(col(c), F.lit("")))
    return any_of([F.contains(lowered, F.lit(n.lower())) for n in needles])


def any_of(tests: list[Column]) -> Column:
    result = F.lit(False)
    for i, test in enumerate(tests):
        result = test if i == 0 else result | test
    return result


def matches_format(c: Column | str, fmt: str | None) -> Column:
    """Suffix test for a format.  An empty or unknown format accepts every key."""
    return ends_with_any(c, FORMAT_EXTENSIONS.get(fmt or "", ()))


def matches_pattern(c: Column | str, pattern: str | None) -> Column:
    """Unanchored, case-sensitive search with a Java regular expression."""
    return F.rlike(col(c), F.lit(pattern)) if pattern else F.lit(True)


def matches_prefix(c: Column | str, prefix: str | None) -> Column:
    return F.startswith(col(c), F.lit(prefix)) if prefix else F.lit(True)


def outside_prefixes(c: Column | str, prefixes: Iterable[str]) -> Column:
    """True unless the key lies under one of the internal prefixes."""
    tests = [F.startswith(col(c), F.lit(p)) for p in prefixes]
    return ~any_of(tests) if tests else F.lit(True)


def base64_bytes(c: Column | str) -> Column:
    """Strict base64: padding required, only CR and LF ignored, else NULL.

    Spark's own decoder also takes missing padding and skips inner blanks; both
    show in the number of bytes it returns.
    """
    packed = _without_breaks(col(c))
    decoded = F.try_to_binary(packed, F.lit("base64"))
    return F.when(_strict_base64(packed, decoded), decoded)


def _without_breaks(c: Column) -> Column:
    broken = F.contains(c, F.lit("\n")) | F.contains(c, F.lit("\r"))
    return F.when(broken, F.translate(c, "\r\n", "")).otherwise(c)


def _strict_base64(packed: Column, decoded: Column) -> Column:
    length = F.octet_length(packed)
    padding = F.when(F.endswith(packed, F.lit("==")), 2).when(F.endswith(packed, F.lit("=")), 1).otherwise(0)
    return (length % 4 == 0) & (F.octet_length(decoded) == length / 4 * 3 - padding)


def base64_texts(data: Column) -> Column:
    """Texts of an array of base64 values; NULL for a value that is not strict.

    Each step binds its result to a lambda variable, so nothing is decoded twice.
    """
    packed = F.transform(data, _without_breaks)
    pairs = F.transform(
        packed, lambda x: F.struct(x.alias("packed"), F.try_to_binary(x, F.lit("base64")).alias("decoded"))
    )
    return F.transform(pairs, lambda p: F.when(_strict_base64(p["packed"], p["decoded"]), bytes_text(p["decoded"])))


def bytes_text(c: Column | str) -> Column:
    """Bytes as text; invalid UTF-8 becomes U+FFFD instead of failing the task."""
    return F.make_valid_utf8(col(c).cast("string"))


def sha256_hex(c: Column | str) -> Column:
    return F.sha2(col(c), 256)


def first_set(*cols: Column | str) -> Column:
    """First value that is set.  An empty string counts as set."""
    return F.coalesce(*[col(c) for c in cols])


def first_non_empty(*cols: Column | str) -> Column:
    """First value that is neither NULL nor the empty string."""
    return F.coalesce(*[F.nullif(col(c), F.lit("")) for c in cols])


def mask(c: Column | str, style: str = "edges") -> Column:
    """Hide a secret: ``full`` -> ``***``; ``edges`` keeps 6 characters on each
    side of values longer than 12 characters and leaves shorter ones alone."""
    value = col(c)
    if style == "full":
        return F.when(value.isNotNull(), F.lit("***"))
    if style != "edges":
        raise ValueError(f"unknown mask style: {style}")
    edges = F.concat(F.left(value, F.lit(6)), F.lit("..."), F.right(value, F.lit(6)))
    return F.when(F.length(value) > 12, edges).otherwise(value)


def lenient_count(c: Column | str) -> Column:
    """A count that arrives as a number or as numeric text -> BIGINT or NULL."""
    digits = F.regexp_extract(col(c).cast("string"), r"^\s*([+-]?\d+)", 1)
    return digits.try_cast("bigint")


def instant(ts: datetime) -> Column:
    """A Python time as a timestamp.  Without a zone it is meant in the session's
    time zone, not in that of the machine the driver runs on."""
    return F.lit(ts.isoformat(sep=" ")).cast("timestamp")


def millis_timestamp(c: Column | str) -> Column:
    """Epoch milliseconds -> timestamp."""
    return F.timestamp_millis(col(c))


def hour_path(c: Column | str) -> Column:
    """``YYYY/MM/DD/HH`` of a timestamp."""
    return F.date_format(col(c), "yyyy/MM/dd/HH")
