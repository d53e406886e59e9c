"""Loading of governance reference rows and of the links that annotate a dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions.text import surrogate_key
from recordloom.operators.merge import insert_ignore, insert_where_absent, upsert
from recordloom.session import stage
from recordloom.sources.tables import values_df

Tables = dict[str, DataFrame]

# --- fixed values: the reference rows every governance warehouse starts with -----------------

ROLES = [
    ("Data Owner",
     "Executive accountable for data assets within a program or mission area.",
     "Approve permissible uses, allocate resources for data quality remediation, and escalate policy exceptions.",
     "executive"),
    ("Data Steward",
     "Operational lead responsible for data quality, metadata completeness, and issue triage.",
     "Maintain business metadata, coordinate data quality assessments, and ensure policy adherence.",
     "manager"),
    ("Privacy Officer",
     "Agency official who oversees privacy impact assessments and privacy risk mitigations.",
     "Review data collections for privacy compliance, manage consent artifacts, and respond to incidents.",
     "executive"),
    ("Security Officer",
     "Cybersecurity authority responsible for system authorization and security controls.",
     "Validate security markings, monitor audit logs, and certify system security posture.",
     "executive"),
    ("Data Governance Council Chair",
     "Chairperson for the agency-wide Data Governance Council.",
     "Set meeting agendas, ratify policy updates, and broker decisions across stakeholder groups.",
     "executive"),
]
POLICIES = [
    ("Privacy Act of 1974", "privacy", "5 U.S.C. § 552a",
     "Governs the collection, maintenance, use, and dissemination of personally identifiable information by federal agencies.",
     "1974-09-27", 365),
    ("CIPSEA Confidentiality", "privacy", "44 U.S.C. § 3501",
     "Requires confidentiality protections for statistical data and restricts re-identification.", "2002-12-17", 365),
    ("OMB M-19-23 FDS Strategy", "governance", "OMB Memorandum M-19-23",
     "Establishes Federal Data Strategy implementation practices and governance guidelines.", "2019-06-04", 365),
    ("FedRAMP High Baseline", "cybersecurity", "FedRAMP",
     "Defines security controls and assessment procedures for high-impact cloud systems.", "2017-06-01", 365),
    ("Records Retention Schedule", "retention", "Agency Records Schedule",
     "Specifies retention and disposition requirements for administrative records.", "2021-01-01", 365),
]
MARKINGS = [
    ("Public", "Unrestricted public data.", "low"),
    ("Controlled Unclassified Information", "CUI requiring safeguarding or dissemination controls.", "moderate"),
    ("High-Value Asset", "Information systems designated as high value assets requiring heightened security.", "high"),
]
USES = [
    ("Privacy Act of 1974", "Program service delivery",
     "Use PII to determine eligibility and deliver services for the originating program.", True, "Data Owner"),
    ("Privacy Act of 1974", "Statistical analysis with de-identification",
     "Use de-identified records for internal statistical reporting when privacy risk mitigations are applied.", True,
     "Privacy Officer"),
    ("CIPSEA Confidentiality", "Statistical release",
     "Publish aggregate statistical data that meets disclosure avoidance standards.", True, "Data Governance Council Chair"),
    ("OMB M-19-23 FDS Strategy", "Data inventory publication",
     "Publish dataset metadata to the public enterprise data inventory.", False, "Data Steward"),
    ("FedRAMP High Baseline", "Operational monitoring",
     "Use security log data for continuous monitoring and incident response.", False, "Security Officer"),
]

# --- end of fixed values ---------------------------------------------------------------------


def with_key(df: DataFrame, key: str, *natural_key: Column) -> DataFrame:
    """Rows with a repeatable key in place of a random one."""
    return df.withColumn(key, surrogate_key(*natural_key))


def seed_tables(spark: SparkSession, t: Tables) -> Tables:
    """Roles, policies, markings and permissible uses added where their names are new."""
    roles = with_key(
        values_df(spark, ROLES, "name string, description string, responsibilities string, authority_level string"),
        "governance_role_id", F.lower("name"),
    )
    policies = with_key(
        values_df(
            spark, POLICIES,
            "name string, policy_type string, authority string, summary string, effective_date date, review_cycle_days int",
        ),
        "policy_id", F.lower("name"),
    )
    markings = with_key(
        values_df(spark, MARKINGS, "name string, description string, classification_level string"), "security_marking_id", F.lower("name")
    )
    uses = values_df(
        spark, USES,
        "policy_name string, use_case string, description string, requires_approval boolean, approval_authority string",
    )
    result = dict(t)
    result["governance_role"] = insert_ignore(t["governance_role"], roles, [F.lower("name")])
    result["policy"] = insert_ignore(t["policy"], policies, [F.lower("name")])
    result["security_marking"] = insert_ignore(t["security_marking"], markings, [F.lower("name")])
    linked = link_by_name(uses, result["policy"], "policy_name", "policy_id")
    linked = with_key(linked, "permissible_use_id", F.col("policy_id"), F.lower("use_case"))
    result["permissible_use"] = insert_ignore(t["permissible_use"], linked, ["policy_id", F.lower("use_case")])
    return result


def link_by_name(rows: DataFrame, dim: DataFrame, name_column: str, dim_key: str) -> DataFrame:
    """Rows with the key of the dimension row they name; rows that name nothing are left out."""
    return rows.join(dim.select(dim_key, F.col("name").alias(name_column)), name_column)


def upsert_agency(agency: DataFrame, rows: DataFrame, as_of: str) -> DataFrame:
    """By name in any letter case: acronym, description and contact are updated, the rest stays."""
    stamp = F.lit(as_of).cast(agency.schema["updated_at"].dataType)
    return upsert(
        agency, with_key(rows, "agency_id", F.lower("name")) if "agency_id" not in rows.columns else rows,
        [F.lower("name")], ["acronym", "description", "contact_email"],
        {"updated_at": stamp}, {"created_at": stamp, "updated_at": stamp},
    )


def upsert_dataset(dataset: DataFrame, rows: DataFrame, as_of: str) -> DataFrame:
    """By source identifier; sensitivity and source date of a known dataset are not touched."""
    stamp = F.lit(as_of).cast(dataset.schema["updated_at"].dataType)
    return upsert(
        dataset, rows, ["source_identifier"],
        ["title", "description", "agency_id", "landing_page", "license", "public_access_level"],
        {"updated_at": stamp}, {"created_at": stamp, "updated_at": stamp, "harvest_timestamp": stamp},
    )


def upsert_person(person: DataFrame, rows: DataFrame) -> DataFrame:
    """Update-else-insert by e-mail in any letter case."""
    return upsert(person, rows, [F.lower("email")], ["full_name", "organization"])


def assign_tags(t: Tables, wanted: DataFrame, tag_source: str = "governance") -> DataFrame:
    """New ``dataset_tag`` for ``wanted (source_identifier, name)``.

    Two equi joins replace the product of datasets and tags: only wanted pairs are formed.
    """
    pairs = (
        wanted.join(t["dataset"].select("source_identifier", "dataset_id"), "source_identifier")
        .join(t["tag"].select("name", "tag_id"), "name")
        .select("dataset_id", "tag_id", F.lit(tag_source).alias("tag_source"))
    )
    return insert_ignore(t["dataset_tag"], pairs, ["dataset_id", "tag_id", "tag_source"])


def apply_policies(t: Tables, wanted: DataFrame) -> DataFrame:
    """New ``dataset_policy`` for ``wanted (source_identifier, policy_name)``."""
    pairs = link_by_name(wanted, t["policy"], "policy_name", "policy_id").join(
        t["dataset"].select("source_identifier", "dataset_id"), "source_identifier"
    )
    return insert_ignore(t["dataset_policy"], pairs, ["dataset_id", "policy_id"])


def add_conditions(t: Tables, wanted: DataFrame) -> DataFrame:
    """New ``permissible_use_condition`` rows that are not there yet, by use, dataset, type and value."""
    return insert_where_absent(
        t["permissible_use_condition"], wanted,
        ["permissible_use_id", "dataset_id", "condition_type", "condition_value"],
    )


def assign_roles(t: Tables, wanted: DataFrame) -> DataFrame:
    """New ``role_assignment`` rows for ``wanted (role_name, email, source_identifier, ...)``."""
    linked = (
        link_by_name(wanted, t["governance_role"], "role_name", "governance_role_id")
        .withColumn("_email", F.lower("email"))
        .join(t["person"].select(F.lower("email").alias("_email"), "person_id"), "_email")
        .join(t["dataset"].select("source_identifier", "dataset_id"), "source_identifier")
    )
    linked = with_key(linked, "role_assignment_id", F.col("governance_role_id"), F.col("person_id"), F.col("dataset_id")) \
        if "role_assignment_id" not in wanted.columns else linked
    return insert_where_absent(t["role_assignment"], linked, ["governance_role_id", "person_id", "dataset_id"])


def with_dataset(t: Tables, wanted: DataFrame) -> DataFrame:
    """``wanted`` with the ``dataset_id`` of its ``source_identifier``; rows that name no dataset are left out."""
    return wanted.join(t["dataset"].select("source_identifier", "dataset_id"), "source_identifier")


def add_distributions(t: Tables, wanted: DataFrame) -> DataFrame:
    """New ``distribution`` rows for ``wanted (source_identifier, download_url, ...)`` not there yet, by dataset and address."""
    rows = with_key(with_dataset(t, wanted), "distribution_id", F.col("dataset_id"), F.col("download_url"))
    return insert_where_absent(t["distribution"], rows, ["dataset_id", "download_url"])


def assign_markings(t: Tables, wanted: DataFrame) -> DataFrame:
    """New ``dataset_security_marking`` for ``wanted (source_identifier, marking_name, ...)``."""
    named = link_by_name(wanted, t["security_marking"], "marking_name", "security_marking_id")
    return insert_ignore(t["dataset_security_marking"], with_dataset(t, named), ["dataset_id", "security_marking_id"])


def link_conditions(t: Tables, wanted: DataFrame) -> DataFrame:
    """``wanted (policy_name, use_case, source_identifier, condition_...)`` with the keys of its use and dataset."""
    uses = link_by_name(wanted, t["policy"], "policy_name", "policy_id").join(
        t["permissible_use"].select("policy_id", "use_case", "permissible_use_id"), ["policy_id", "use_case"]
    )
    rows = with_dataset(t, uses)
    return with_key(
        rows, "permissible_use_condition_id",
        F.col("permissible_use_id"), F.col("dataset_id"), F.col("condition_type"), F.col("condition_value"),
    )


def enrich_datasets(t: Tables, rows: Tables, as_of: str) -> Tables:
    """All governance tables after a batch of annotated datasets; a second run with the same batch changes no row but time stamps.

    ``rows`` holds, under the names of the tables, what :func:`upsert_agency`, :func:`upsert_dataset`
    (with ``agency_name``), :func:`add_distributions`, :func:`assign_tags`, :func:`apply_policies`,
    :func:`link_conditions`, :func:`upsert_person`, :func:`assign_roles` and :func:`assign_markings`
    take; ``tag`` has new tags. A table without rows in the batch stays as it is. Steps run in this order,
    so links find what the batch itself brings. Each changed table is written down once, however many later steps read it.
    """
    t = dict(t)

    def step(name: str, change) -> None:
        if name in rows:
            t[name] = stage(change(rows[name]), name)

    step("agency", lambda r: upsert_agency(t["agency"], r, as_of))
    agency = t["agency"].select("agency_id", F.lower("name").alias("_agency"))
    step("dataset", lambda r: upsert_dataset(t["dataset"], with_key(
        r.withColumn("_agency", F.lower("agency_name")).join(agency, "_agency"), "dataset_id", F.col("source_identifier")), as_of))
    step("distribution", lambda r: add_distributions(t, r))
    step("tag", lambda r: insert_ignore(
        t["tag"], with_key(r, "tag_id", F.lower("name"), F.col("tag_type")), [F.lower("name"), "tag_type"]))
    step("dataset_tag", lambda r: assign_tags(t, r))
    step("dataset_policy", lambda r: apply_policies(t, r))
    step("permissible_use_condition", lambda r: add_conditions(t, link_conditions(t, r)))
    step("person", lambda r: upsert_person(t["person"], with_key(r, "person_id", F.lower("email"))))
    step("role_assignment", lambda r: assign_roles(t, r))
    step("dataset_security_marking", lambda r: assign_markings(t, r))
    return t
