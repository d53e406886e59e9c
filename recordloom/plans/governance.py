"""Denormalised governance views over a dict of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.operators.aggregates import collect_rows_by, distinct_names_by
from recordloom.operators.joins import left_join_many

Tables = dict[str, DataFrame]


def catalog_dataset(t: Tables) -> DataFrame:
    """One row per dataset with its agency and the distinct names of its tags, markings and policies.

    Each bridge is reduced to one array per dataset before it is joined, so the rows
    never multiply to tags x markings x policies. No name gives NULL.
    """
    agency = t["agency"].select(
        "agency_id", F.col("name").alias("agency_name"), F.col("acronym").alias("agency_acronym")
    )
    tags = distinct_names_by(t["dataset_tag"], t["tag"], "dataset_id", "tag_id", "tags")
    markings = distinct_names_by(
        t["dataset_security_marking"], t["security_marking"], "dataset_id", "security_marking_id", "security_markings"
    )
    policies = distinct_names_by(t["dataset_policy"], t["policy"], "dataset_id", "policy_id", "policies")
    return (
        t["dataset"]
        .join(agency, "agency_id", "left")
        .join(tags, "dataset_id", "left")
        .join(markings, "dataset_id", "left")
        .join(policies, "dataset_id", "left")
        .select(
            "dataset_id", "title", "description", "source_identifier", "agency_name", "agency_acronym",
            "landing_page", "license", "public_access_level", "is_sensitive", "source_modified",
            "harvest_timestamp", "tags", "security_markings", "policies",
        )
    )


_CONDITION = ("dataset_id", "condition_type", "condition_value", "condition_text", "enforced_by")
_USE = (
    "permissible_use_id", "policy_id", "policy_name", "use_case", "description", "requires_approval", "approval_authority",
)


def _uses(t: Tables) -> DataFrame:
    policy = t["policy"].select("policy_id", F.col("name").alias("policy_name"))
    return t["permissible_use"].join(policy, "policy_id", "left").select(*_USE)


def permissible_use(t: Tables) -> DataFrame:
    """One row per permissible use with its policy name and the array of all its conditions (NULL for none).

    For uses with so many conditions that one array cannot hold them there is :func:`permissible_use_conditions`.
    """
    conditions = collect_rows_by(t["permissible_use_condition"], "permissible_use_id", F.struct(*_CONDITION), "conditions")
    return _uses(t).join(conditions, "permissible_use_id", "left").select(*_USE, "conditions")


def permissible_use_conditions(t: Tables) -> DataFrame:
    """One row per permissible use and condition, and one without condition for a use that has none."""
    conditions = t["permissible_use_condition"].select("permissible_use_id", "permissible_use_condition_id", *_CONDITION)
    return left_join_many(_uses(t), conditions, "permissible_use_id").select(*_USE, "permissible_use_condition_id", *_CONDITION)


def governance_assignments(t: Tables) -> DataFrame:
    """Role assignments with role, person and, where there is one, dataset."""
    role = t["governance_role"].select(
        "governance_role_id", F.col("name").alias("role_name"),
        F.col("description").alias("role_description"), "responsibilities",
    )
    person = t["person"].select("person_id", "full_name", "email", "organization")
    dataset = t["dataset"].select("dataset_id", F.col("title").alias("dataset_title"), F.col("dataset_id").alias("_found"))
    return (
        t["role_assignment"]
        .join(role, "governance_role_id")
        .join(person, "person_id")
        .join(dataset, "dataset_id", "left")
        .select(
            "role_assignment_id", "role_name", "role_description", "responsibilities", "scope",
            "start_date", "end_date", "assigned_by", "notes", "full_name", "email", "organization",
            F.col("_found").alias("dataset_id"), "dataset_title",
        )
    )


def data_access_requests(t: Tables) -> DataFrame:
    """Access requests with dataset title and decision, where known."""
    dataset = t["dataset"].select("dataset_id", F.col("title").alias("dataset_title"), F.col("dataset_id").alias("_found"))
    decision = t["decision_log"].select("decision_log_id", "decision_type", "decision_text", "decided_by", "decided_on")
    return (
        t["data_access_request"]
        .join(dataset, "dataset_id", "left")
        .join(decision, "decision_log_id", "left")
        .select(
            "request_id", F.col("_found").alias("dataset_id"), "dataset_title", "requested_by", "requested_on",
            "purpose", "status", "decision_type", "decision_text", "decided_by", "decided_on",
        )
    )
