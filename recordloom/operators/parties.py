"""Unnesting of array-or-object party documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions.dates import safe_to_date
from recordloom.functions.json import marked_elements, marked_json, unpack_fields
from recordloom.functions.text import to_bigint
from recordloom.operators.filters import usable_document
from recordloom.schemas import PARTY_FIELDS


def explode_json_documents(
    df: DataFrame, column: str, fields: dict[str, str], keep: list[Column], element: str = "_element"
) -> DataFrame:
    """One row per element of each document: ``keep`` plus one text column per field, or the element without any.

    An object is one element, an empty array none; unusable text yields no row. A
    scalar or ``null`` element is a row whose fields are all NULL. The document is
    parsed in a projection of its own, so that its result is used, not recomputed.
    """
    documents = df.where(usable_document(F.col(column))).select(
        *keep, F.col(column).alias("_text"), marked_json(F.col(column)).alias("_marked")
    )
    elements = documents.select(
        "*", F.explode(marked_elements(F.col("_marked"), F.col("_text"))).alias(element)
    ).drop("_text", "_marked")
    if not fields:
        return elements
    record = elements.withColumn("_record", unpack_fields(F.col(element), fields))
    return record.select(
        *[c for c in elements.columns if c != element],
        *[F.col("_record")[key].alias(out) for out, key in fields.items()],
    )


def unnest_party(df: DataFrame, column: str, id_column: str = "id") -> DataFrame:
    """Party rows: ``row_id`` and the eleven party columns."""
    rows = explode_json_documents(df, column, PARTY_FIELDS, [to_bigint(F.col(id_column)).alias("row_id")])
    return rows.withColumn("removal_date", safe_to_date(F.col("removal_date"), "MM/DD/YYYY"))
