"""Canonical JSON and the content hash of a question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SHORT_ESCAPES = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}
_OTHER_CONTROLS = [chr(c) for c in range(32) if chr(c) not in _SHORT_ESCAPES]


def _escaped_by_hand(text: Column) -> Column:
    for raw, mark in _SHORT_ESCAPES.items():
        text = F.replace(text, F.lit(raw), F.lit(mark))
    for raw in _OTHER_CONTROLS:
        text = F.replace(text, F.lit(raw), F.lit(f"\\u{ord(raw):04x}"))
    return F.concat(F.lit('"'), text, F.lit('"'))


def json_string(text: Column) -> Column:
    """JSON string literal with non-ASCII kept and lower-case ``\\u00xx`` escapes.

    Spark's JSON writer does the work in one pass. It spells rare control characters with
    upper-case hex, which would change the hash, so texts that show such an escape are escaped
    by replacement instead.
    """
    wrapped = F.to_json(F.struct(text.alias("v")))
    literal = F.substr(wrapped, F.lit(len('{"v":') + 1), F.length(wrapped) - len('{"v":}'))
    return F.when(wrapped.contains("\\u00"), _escaped_by_hand(text)).when(text.isNotNull(), literal)


def json_value(column: Column, data_type: T.DataType) -> Column:
    if isinstance(data_type, T.StringType):
        encoded = json_string(column)
    elif isinstance(data_type, T.ArrayType):
        items = F.transform(column, lambda x: json_value(x, data_type.elementType))
        encoded = F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))
    elif isinstance(data_type, (T.IntegerType, T.LongType, T.ShortType, T.BooleanType)):
        encoded = column.cast("string")
    else:
        raise TypeError(f"no canonical JSON form for {data_type.simpleString()}")
    return F.coalesce(encoded, F.lit("null"))


def canonical_json(df: DataFrame, columns: list[str] | None = None) -> Column:
    """One JSON object per row: keys sorted, ``", "`` and ``": "`` as separators."""
    names = sorted(columns or df.columns)
    parts: list[Column] = []
    for position, name in enumerate(names):
        lead = "{" if position == 0 else ", "
        parts.append(F.lit(f'{lead}"{name}": '))
        parts.append(json_value(F.col(name), df.schema[name].dataType))
    return F.concat(*parts, F.lit("}"))


def with_unique_id(df: DataFrame) -> DataFrame:
    """Put the MD5 of the canonical record in front as ``unique_id``."""
    if "unique_id" in df.columns:
        raise ValueError("the record already has a unique_id; drop it before hashing")
    return df.select(F.md5(canonical_json(df)).alias("unique_id"), "*")
