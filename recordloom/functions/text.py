"""Text clean-up, casts and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed value: how a court is named inside a file name
COURT_FILE_PATTERN = r"^.*_([A-Za-z\s]+County[A-Za-z\s]+Court)\.csv$"
UNKNOWN_COURT = "Unknown Court"


def null_if_in(col: Column, sentinels: tuple[str, ...] = ("NA",)) -> Column:
    """NULL where the text is one of ``sentinels``."""
    return F.when(~col.isin(*sentinels), col)


def nullif_na(col: Column) -> Column:
    """NULL for ``'NA'`` and for empty text."""
    return null_if_in(col, ("NA", ""))


def to_bigint(col: Column, on_error: str = "raise") -> Column:
    """Text to bigint; bad text fails the job unless ``on_error='null'``."""
    if on_error == "null":
        return col.try_cast("bigint")
    return col.cast("bigint")


def court_from_filename(col: Column) -> Column:
    """Court named in a file name, ``'Unknown Court'`` when there is none, NULL for NULL."""
    return F.when(
        col.isNotNull(),
        F.coalesce(F.nullif(F.regexp_extract(col, COURT_FILE_PATTERN, 1), F.lit("")), F.lit(UNKNOWN_COURT)),
    )


def content_hash(col: Column) -> Column:
    return F.md5(col)


def surrogate_key(*natural_key: Column) -> Column:
    """Repeatable key of a row: hash of its natural key, with NULL parts told apart from text."""
    parts = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("~")) for c in natural_key]
    return F.sha2(F.concat_ws("\u0001", *parts), 256)
