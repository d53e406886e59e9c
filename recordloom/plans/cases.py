"""Case pipeline: lookup join, one-pass routing, case and party tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions.dates import safe_to_date
from recordloom.functions.labels import label_subtype
from recordloom.functions.text import to_bigint
from recordloom.operators.audit import StepCounter
from recordloom.operators.filters import mentions_any, null_sentinels
from recordloom.operators.joins import left_join_many, lookup_join
from recordloom.operators.parties import unnest_party
from recordloom.schemas import CASE_FIELDS, CIVIL_SUBTYPES, CLEANED_COLUMNS, EXCLUDED_SYSTEMS
from recordloom.sources.tables import materialize

PARTY_BRANCHES = ["A", "B1"]


def label_with_lookup(df: DataFrame, lookup: DataFrame, key: str = "case_type", value: str = "subtype") -> DataFrame:
    """Add the lookup value; a key with several values repeats its rows, a missing one gives NULL.

    Runs on raw keys, before sentinels are cleaned: ``NA`` may be a lookup key.
    """
    return lookup_join(df, lookup.select(key, value), key)


def is_excluded_system(column: str = "court_system") -> Column:
    return mentions_any(F.col(column), EXCLUDED_SYSTEMS)


def route(labelled: DataFrame) -> DataFrame:
    """Clean each row, label it and name its branch, in one pass over the joined rows.

    ``A``: civil subtype, no excluded system, no ``cjis``. ``B1``: other subtypes whose
    system says CIVIL. ``B2``: the same in another letter case. NULL: unused.
    """
    clean = null_sentinels(labelled, CLEANED_COLUMNS)
    civil = F.coalesce(F.col("subtype").isin(*CIVIL_SUBTYPES), F.lit(False))
    branch = (
        F.when(civil, F.when(~is_excluded_system() & F.col("cjis").isNull(), "A"))
        .when(F.col("court_system").contains("CIVIL"), "B1")
        .when(F.upper("court_system").contains("CIVIL"), "B2")
    )
    category = F.when(civil, label_subtype(F.col("subtype"), "A")).otherwise(label_subtype(F.col("subtype"), "B"))
    return clean.withColumns({"category": category, "branch": branch})


def project_case(df: DataFrame, on_error: str = "raise", carry: list[str] = ()) -> DataFrame:
    """The sixteen case columns, after the columns of ``carry`` if any."""
    converted = {
        "row_id": to_bigint(F.col("id"), on_error),
        "file_date": safe_to_date(F.col("filing_date")),
    }
    return df.select(*carry, *[converted.get(out, F.col(c)).alias(out) for out, c in CASE_FIELDS.items()])


def in_branch(routed: DataFrame, branch: str | list[str] | None) -> DataFrame:
    if branch is None:
        return routed.where(F.col("branch").isNotNull())
    return routed.where(F.col("branch").isin(branch if isinstance(branch, list) else [branch]))


def build_cases(routed: DataFrame, branch: str | list[str] | None = None) -> DataFrame:
    """Distinct case rows of a branch, or of all.

    Branches differ in category or court system, so one dedup over all of them equals
    the union of a dedup per branch.
    """
    return project_case(in_branch(routed, branch)).distinct()


def build_parties(routed: DataFrame, column: str, branch: str | list[str] | None = None) -> DataFrame:
    """Party rows of branch A and B1 cases, once per joined row."""
    return unnest_party(in_branch(routed, branch or PARTY_BRANCHES), column)


def final_tables(source: DataFrame, case_types: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(cases, defendants, plaintiffs)``; each reads only the source columns it needs."""
    routed = route(label_with_lookup(source, case_types))
    return build_cases(routed), build_parties(routed, "defendant"), build_parties(routed, "plaintiff")


def case_party_report(cases: DataFrame, parties: DataFrame, prefix: str) -> DataFrame:
    """Cases with one row per party, and a row without party for cases that have none."""
    named = parties.select("row_id", F.col("name").alias(f"{prefix}_name"), "city", "state")
    return left_join_many(cases.select("row_id", "case_number", "caption", "category", "file_date"), named, "row_id")


def publish(source: DataFrame, case_types: DataFrame, out_dir: str, counter: StepCounter | None = None) -> dict[str, DataFrame]:
    """Replace the three result tables.

    The routed rows are not staged: the lookup join needs no shuffle, so reading the
    few routing columns again costs less than writing the wide rows once more. A ``counter`` gets the rows of
    each step as the tables are written.
    """
    cases, defendants, plaintiffs = final_tables(source, case_types)
    if counter:
        labelled = label_with_lookup(counter.watch(source, "source_data"), case_types)
        civil = F.col("subtype").isin(*CIVIL_SUBTYPES)
        routed = counter.watch(route(labelled), "labelled", civil=civil, accepted=F.col("branch") == "A")
        cases = counter.watch(build_cases(routed), "final_cases")
        defendants, plaintiffs = counter.watch(defendants, "final_defendants"), counter.watch(plaintiffs, "final_plaintiffs")
    results = {"final_cases": cases, "final_defendants": defendants, "final_plaintiffs": plaintiffs}
    return {name: materialize(df, f"{out_dir.rstrip('/')}/{name}") for name, df in results.items()}
