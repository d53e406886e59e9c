"""Column expressions; all built from JVM-side functions."""

from recordloom.functions.dates import safe_to_date, seconds_between
from recordloom.functions.json import json_elements, safe_json, unpack_fields
from recordloom.functions.labels import label_subtype, threshold_status
from recordloom.functions.text import (
    content_hash,
    court_from_filename,
    nullif_na,
    null_if_in,
    surrogate_key,
    to_bigint,
)

__all__ = [
    "content_hash", "court_from_filename", "json_elements", "label_subtype", "null_if_in", "nullif_na",
    "safe_json", "safe_to_date", "seconds_between", "surrogate_key", "threshold_status", "to_bigint",
    "unpack_fields",
]
