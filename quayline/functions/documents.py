"""JSON documents as VARIANT values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayline.functions.text import col


STRICT_JSON = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}

#: What documents begin with.
BEGINNINGS = '{["-0123456789tfn'


def parsed_document(c: Column | str) -> Column:
    """One JSON text -> VARIANT, NULL if the text is not exactly one document."""
    items = as_element(c)
    alone = F.get(F.transform(F.array(items), lambda x: F.when(F.size(x) == 1, F.get(x, F.lit(0)))), F.lit(0))
    # A failed parse costs more than a good one: words are told by their first sign.
    first = F.substring(F.ltrim(col(c), F.lit(" \t\r\n")), 1, 1)
    begins = F.contains(F.lit(BEGINNINGS), first)
    # Without a bracket that closes, no text gets out of the array.
    return F.when(begins & (~F.contains(col(c), F.lit("]")) | fits_object(c)), alone)


def as_element(c: Column | str) -> Column:
    """The documents of a text that stands inside an array; NULL if malformed.

    Plain parsing would stop at the end of the first document and silently ignore a
    second one behind it.  A text can close the array itself, but no text closes both
    an array and an object: ask ``fits_object`` too.
    """
    return F.from_json(F.concat(F.lit("["), col(c), F.lit("]")), "array<variant>", STRICT_JSON)


def fits_object(c: Column | str) -> Column:
    """Whether the text can stand as the value of a field of an object."""
    wrapped = F.concat(F.lit('{"v":'), col(c), F.lit("}"))
    parsed = F.from_json(wrapped, "v variant, _malformed string", {**STRICT_JSON, "columnNameOfCorruptRecord": "_malformed"})
    return parsed.isNotNull() & parsed["_malformed"].isNull()


def document(c: Column | str) -> Column:
    """One JSON text -> VARIANT.  Text that is no JSON is kept as a string value,
    so no row is lost."""
    return F.coalesce(parsed_document(c), col(c).cast("variant"))


def field_path(name: str) -> str:
    return '$["' + name.replace("\\", "\\\\").replace('"', '\\"') + '"]'


def field(c: Column | str, name: str, data_type: str = "string") -> Column:
    """Top-level field of a document, NULL when absent or not convertible."""
    return F.try_variant_get(col(c), field_path(name), data_type)


def type_text(kind: T.DataType) -> str:
    """A type in SQL, with the names of nested fields quoted."""
    if isinstance(kind, T.StructType):
        fields = [f"`{f.name.replace('`', '``')}`: {type_text(f.dataType)}" for f in kind.fields]
        return f"struct<{', '.join(fields)}>"
    if isinstance(kind, T.ArrayType):
        return f"array<{type_text(kind.elementType)}>"
    if isinstance(kind, T.MapType):
        return f"map<{type_text(kind.keyType)}, {type_text(kind.valueType)}>"
    return kind.simpleString()


def typed_columns(c: Column | str, schema: T.StructType | str) -> list[Column]:
    """One typed column per field of ``schema``, read out of a document."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    return [field(c, f.name, type_text(f.dataType)).alias(f.name) for f in schema.fields]
