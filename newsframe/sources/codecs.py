"""Columns that arrive as text or bytes."""

from pyspark.sql import Column
from pyspark.sql import functions as F

_LIST_OPTIONS = {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true"}


def parse_word_list(text: Column) -> Column:
    """Word lists written as ``['a', "b's"]``."""
    return F.from_json(text, "array<string>", _LIST_OPTIONS)


def decode_utf8(raw: Column) -> Column:
    return F.decode(raw, "UTF-8")


def from_json_text(text: Column, schema: str | None = None) -> Column:
    """JSON text to a value of the given schema, or to a variant when no schema is known."""
    return F.try_parse_json(text) if schema is None else F.from_json(text, schema)


def to_json_text(value: Column) -> Column:
    return F.to_json(value)
