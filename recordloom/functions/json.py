"""Array-or-object JSON documents held in text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# strict JSON: what a jsonb column would accept
_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
_NUL = "\\u0000"
_NUL_ESCAPE = r"(?<!\\)(?:\\\\)*\\u0000"


def _marker(text: Column) -> Column:
    return F.xxhash64(text).cast("string")


def marked_json(text: Column) -> Column:
    """The text parsed as first element of an array that ends with a hash of the text.

    Exactly ``[value, hash]`` comes back only for one valid JSON value: whatever trails
    the value breaks the array or moves the hash.
    """
    return F.from_json(F.concat(F.lit("["), text, F.lit(',"'), _marker(text), F.lit('"]')), "array<string>", _STRICT)


def is_single_json(marked: Column, text: Column) -> Column:
    """Whether ``marked`` shows that ``text`` is one valid JSON value."""
    return (
        (F.size(marked) == 2)
        & (F.get(marked, F.lit(1)) == _marker(text))
        & ~(text.contains(_NUL) & text.rlike(_NUL_ESCAPE))
    )


def marked_elements(marked: Column, text: Column) -> Column:
    """``array<string>`` of JSON texts: the elements of an array, or the single value itself.

    NULL for unusable text, ``[]`` for an empty array; a JSON ``null`` is one NULL element.
    """
    value = F.get(marked, F.lit(0))
    is_array = text.rlike(r"^[ \t\r\n]*\[")
    return F.when(
        is_single_json(marked, text),
        F.when(is_array, F.from_json(value, "array<string>", _STRICT)).otherwise(F.array(value)),
    )


def safe_json(text: Column) -> Column:
    """The text when it holds exactly one valid JSON value, else NULL (also for '' and 'NA')."""
    return F.when(is_single_json(marked_json(text), text), text)


def json_elements(text: Column) -> Column:
    """:func:`marked_elements` of a text column. To parse once, select :func:`marked_json` first."""
    return marked_elements(marked_json(text), text)


def unpack_fields(element: Column, fields: dict[str, str]) -> Column:
    """Struct of text fields of a JSON object; all NULL for any other JSON value."""
    schema = ", ".join(f"`{key}`: string" for key in fields.values())
    return F.from_json(element, f"struct<{schema}>", _STRICT)
