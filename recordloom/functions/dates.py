"""Lenient date parsing."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_DIGITS = {"YYYY": r"(\d{1,4})", "MM": r"(\d{1,2})", "DD": r"(\d{1,2})"}
# what stands between two parts: any separator, or none, whatever the template has there
_SEPARATOR = "[^0-9A-Za-z]*"


def part_order(template: str) -> tuple[str, ...]:
    """The order of ``YYYY``, ``MM`` and ``DD`` in a template whose other characters are separators."""
    order = tuple(re.findall("YYYY|MM|DD", template))
    if sorted(order) != ["DD", "MM", "YYYY"] or re.search("[0-9A-Za-z]", re.sub("YYYY|MM|DD", "", template)):
        raise ValueError(f"a date template names YYYY, MM and DD once each, between separators: {template!r}")
    return order


def date_pattern(order: tuple[str, ...]) -> str:
    """Pattern of the leading text that is read, one group per date part."""
    return rf"^\s*{_SEPARATOR.join(_DIGITS[p] for p in order)}"


def safe_to_date(col: Column, template: str = "YYYY-MM-DD") -> Column:
    """Date in the order of ``template``; NULL when missing, unreadable or not on the calendar.

    A separator of the template stands for any separators in the text, or none. Trailing text is ignored.
    The parts are cast, not parsed by a pattern, which raises an exception inside for every missing or unreadable text.
    """
    order = part_order(template)
    year, month, day = (F.regexp_extract(col, date_pattern(order), order.index(p) + 1) for p in ("YYYY", "MM", "DD"))
    return F.concat_ws("-", F.lpad(year, 4, "0"), month, day).try_cast("date")


def seconds_between(start: Column, end: Column) -> Column:
    """Whole seconds from ``start`` to ``end`` (timestamps without time zone)."""
    return F.timestamp_diff("SECOND", start, end)
