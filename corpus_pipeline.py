"""Curation of a corpus in stages, each one of the operators in ``recordloom.llm``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm import minhash, packing, queries, substrings, toxicity
from recordloom.llm.common import keyed
from recordloom.session import stage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5."""
    weights = queries.toxicity_weights(spark, docs, sf_dir)
    rows = docs.select(F.struct("*").alias("row"), "text")
    return toxicity.score(rows, "row", "text", weights).where("score < 0.5").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates by five-word shingles, the one with the smallest id; of rows with one id the first in the files."""
    rows = keyed(docs.select(F.struct("*").alias("row"), "doc_id", "text"), "rid")
    named = rows.select(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid").alias("name"), "text", "rid")
    found = minhash.near_duplicates(named, "name", "text", words=5, percent=80, row="rid")
    return rows.join(found.where("representative").select("name.rid"), "rid", "left_semi").select("row.*")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of repeated windows of 35 words; others stay as they are."""
    rows = docs.select(F.struct(*[c for c in docs.columns if c not in ("text", "n_chars")]).alias("row"), "text")
    cut = substrings.remove_repeats(rows, "row", "text", length=35, as_they_are=True)
    return cut.select("row.*", F.col("kept").alias("text"), F.length("kept").cast("long").alias("n_chars")).select(*docs.columns)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 2,048 tokens."""
    return packing.pack(docs, "doc_id", "text", queries.BYTE_VOCABULARY, end=1, window=2048)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("repeats", cut_repeats), ("packing", pack_windows),
]

#: Python and learned weights decide here; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written down before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
