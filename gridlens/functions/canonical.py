"""Canonical JSON text (keys sorted recursively, no whitespace) for hashing.

Two paths, both of built-in expressions:

* typed: a struct column is turned into its canonical text with string expressions;
* free-form: a JSON string column of arbitrary shape is parsed to a VARIANT,
  whose objects hold their keys in order; of its text, numbers and the few
  escapes that JavaScript writes otherwise are rewritten token by token.

Keys are written as they are (not escaped) and sorted by UTF-16 code units,
like ``Object.keys(o).sort()``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .formatting import js_number_text


def _utf16_key(k: str) -> bytes:
    return k.encode("utf-16-be", "surrogatepass")


_NEEDS_ESCAPE = '["\\\\\\x00-\\x1f]'


def json_string_text(col: Column) -> Column:
    """JSON string literal of a string column (quotes and escapes), or ``null``.

    Clean strings are simply quoted; only strings holding a quote, a backslash
    or a control character go through the JSON writer.
    """
    arr = F.to_json(F.array(col))          # '["..."]' or '[null]'
    escaped = F.substring(arr, F.lit(2), F.length(arr) - 2)
    return (F.when(col.isNull(), F.lit("null"))
            .when(col.rlike(_NEEDS_ESCAPE), escaped)
            .otherwise(F.concat(F.lit('"'), col, F.lit('"'))))


def canonical_text(col: Column, dtype: T.DataType) -> Column:
    """Canonical JSON of a typed column (struct fields sorted by name)."""
    if isinstance(dtype, T.StructType):
        names = sorted((f.name for f in dtype.fields), key=_utf16_key)
        types = {f.name: f.dataType for f in dtype.fields}
        parts = [F.lit("{")]
        for i, n in enumerate(names):
            parts.append(F.lit(("," if i else "") + f'"{n}":'))
            parts.append(canonical_text(col.getField(n), types[n]))
        parts.append(F.lit("}"))
        return F.when(col.isNull(), F.lit("null")).otherwise(F.concat(*parts))
    if isinstance(dtype, T.ArrayType):
        inner = F.transform(col, lambda x: canonical_text(x, dtype.elementType))
        return F.when(col.isNull(), F.lit("null")).otherwise(F.concat(F.lit("["), F.array_join(inner, ","), F.lit("]")))
    if isinstance(dtype, T.StringType):
        return json_string_text(col)
    if isinstance(dtype, T.BooleanType):
        return F.when(col.isNull(), F.lit("null")).when(col, F.lit("true")).otherwise(F.lit("false"))
    if isinstance(dtype, (T.DoubleType, T.FloatType, T.DecimalType)):
        return F.coalesce(js_number_text(col.cast("double")), F.lit("null"))
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return F.coalesce(col.cast("string"), F.lit("null"))
    raise TypeError(f"no canonical form for {dtype}")


def canonical_struct(df, fields: dict) -> Column:
    """Canonical text of ``struct(**fields)`` where values are column names of ``df``."""
    st = F.struct(*[F.col(c).alias(k) for k, c in fields.items()])
    dtype = T.StructType([T.StructField(k, df.schema[c].dataType) for k, c in fields.items()])
    return canonical_text(st, dtype)


# ---------------------------------------------------------------- free-form path
#: A token of compact JSON text: a string, a number, a literal, or one character of punctuation.
_TOKEN = r'"(?:[^"\\]|\\.)*+"|-?[0-9][0-9.eE+-]*|[a-z]+|[\[\]{},:]'


def canonical_json(text: Column) -> Column:
    """Canonical text of JSON text; NULL for a missing text and for one that isn't JSON.

    Of equal keys in an object the last one counts (session setting
    ``spark.sql.variant.allowDuplicateKeys``).  A number beyond the doubles reads
    as the string ``Infinity``.
    """
    tokens = F.regexp_extract_all(F.to_json(F.try_parse_json(text)), F.lit(_TOKEN), 0)
    return F.array_join(F.transform(tokens, lambda t, i: _canonical_token(t, F.get(tokens, i + 1))), "")


def _canonical_token(t: Column, following: Column) -> Column:
    number = F.coalesce(js_number_text(t.try_cast("double")), F.lit("null"))
    key = F.concat(F.lit('"'), F.get_json_object(F.concat(F.lit("["), t, F.lit("]")), "$[0]"), F.lit('"'))
    return (F.when(t.rlike("^-?[0-9]"), number)
            .when(~t.startswith('"') | ~t.contains("\\"), t)
            .when(following == ":", key)
            .when(t.contains("\\u00"), _lower_escapes(t)).otherwise(t))


def _lower_escapes(t: Column) -> Column:
    """Control characters' escapes with lower-case digits; a backslash before them is not an escape of its own."""
    for digit in "ABCDEF":
        t = F.regexp_replace(t, r"(?<=(?<!\\)(?:\\\\){0,99}\\u00[01])" + digit, digit.lower())
    return t
