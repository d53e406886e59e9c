"""Column layouts of the record files, the published tables and the governance tables."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import types as T

# --- fixed values: layout of the incoming record files and of the result tables -------------

CASE_FILE_COLUMNS = [
    "row_num", "id", "case_number", "caption", "name", "dob", "party_type", "court", "court_id",
    "case_type", "filing_date", "status", "court_system", "checksum", "misc", "last_scrape",
    "not_found_at", "created_at", "updated_at", "tracking_number", "case_type_code", "location",
    "defendant", "plaintiff", "error", "versions", "parser", "cjis", "sentence_length",
]
LOOKUP_FILE_COLUMNS = ["case_count", "case_type", "subtype", "notes", "col5", "col6", "col7"]

# columns whose "NA" is data, not a missing value
UNCLEANED_COLUMNS = ("id", "created_at", "updated_at", "error")

# result column -> source column; row_id and file_date are converted on the way
CASE_FIELDS = {
    "row_id": "id",
    "case_number": "case_number",
    "caption": "caption",
    "name": "name",
    "birth_date": "dob",
    "role": "party_type",
    "court": "court",
    "case_type": "case_type",
    "file_date": "filing_date",
    "case_status": "status",
    "court_system": "court_system",
    "create_date": "created_at",
    "update_date": "updated_at",
    "court_location": "location",
    "versions": "versions",
    "category": "category",
}

# result column -> key in the party document; "Amount" does hold the second address line
PARTY_FIELDS = {
    "name": "Name",
    "city": "City",
    "state": "State",
    "zip": "Zip Code",
    "address": "Address",
    "address_ln1": "Address1",
    "address_ln2": "Amount",
    "party_num": "Party No.",
    "role": "Party Type",
    "org_name": "Business or Organization Name",
    "removal_date": "Removal Date",
}

CIVIL_SUBTYPES = ["D", "E", "PE", "PD", "PE, PD", "PD, PE"]
SUBTYPE_LABELS = {
    "PE, PD": "UNDETERMINED",
    "PD, PE": "UNDETERMINED",
    "D": "DEBT",
    "E": "EVICTION",
    "PD": "POSSIBLE DEBT",
    "PE": "POSSIBLE EVICTION",
}
EXCLUDED_SYSTEMS = ["CRIMINAL", "FAMILY", "TRAFFIC", "PROBATE"]

LOAD_STATUSES = ["started", "completed", "failed"]
FAILED_LOAD_MESSAGE = "Copy command failed"

# --- end of fixed values ---------------------------------------------------------------------

CLEANED_COLUMNS = [c for c in CASE_FILE_COLUMNS if c not in ("row_num", *UNCLEANED_COLUMNS)]

CASE_FILE_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in CASE_FILE_COLUMNS])
LOOKUP_FILE_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in LOOKUP_FILE_COLUMNS])

LANDING_SCHEMA = T.StructType([
    *CASE_FILE_SCHEMA.fields,
    T.StructField("loaded_at", T.TimestampNTZType()),
    T.StructField("source_id", T.LongType()),
    T.StructField("load_id", T.LongType()),
])

LEDGER_SCHEMA = T.StructType([
    T.StructField("load_id", T.LongType()),
    T.StructField("file_name", T.StringType()),
    T.StructField("file_path", T.StringType()),
    T.StructField("file_size_bytes", T.LongType()),
    T.StructField("rows_loaded", T.LongType()),
    T.StructField("load_started_at", T.TimestampNTZType()),
    T.StructField("load_completed_at", T.TimestampNTZType()),
    T.StructField("load_status", T.StringType()),
    T.StructField("error_message", T.StringType()),
    T.StructField("file_hash", T.StringType()),
    T.StructField("court_name", T.StringType()),
    T.StructField("data_date", T.DateType()),
])


class ForeignKey(NamedTuple):
    child: str
    column: str
    parent: str
    parent_key: str
    on_delete: str  # "cascade" or "set null"


GOVERNANCE_KEYS = {
    "agency": "agency_id",
    "dataset": "dataset_id",
    "distribution": "distribution_id",
    "tag": "tag_id",
    "policy": "policy_id",
    "policy_clause": "policy_clause_id",
    "dataset_policy": "dataset_policy_id",
    "permissible_use": "permissible_use_id",
    "permissible_use_condition": "permissible_use_condition_id",
    "security_marking": "security_marking_id",
    "dataset_security_marking": "dataset_security_marking_id",
    "governance_role": "governance_role_id",
    "person": "person_id",
    "role_assignment": "role_assignment_id",
    "decision_log": "decision_log_id",
    "data_access_request": "request_id",
    "dataset_lineage": "dataset_lineage_id",
    "glossary_term": "glossary_term_id",
}


def _fk(child: str, column: str, parent: str, on_delete: str = "cascade") -> ForeignKey:
    return ForeignKey(child, column, parent, GOVERNANCE_KEYS[parent], on_delete)


GOVERNANCE_FOREIGN_KEYS = [
    _fk("dataset", "agency_id", "agency", "set null"),
    _fk("distribution", "dataset_id", "dataset"),
    _fk("dataset_tag", "dataset_id", "dataset"),
    _fk("dataset_tag", "tag_id", "tag"),
    _fk("policy_clause", "policy_id", "policy"),
    _fk("dataset_policy", "dataset_id", "dataset"),
    _fk("dataset_policy", "policy_id", "policy"),
    _fk("permissible_use", "policy_id", "policy"),
    _fk("permissible_use_condition", "permissible_use_id", "permissible_use"),
    _fk("permissible_use_condition", "dataset_id", "dataset"),
    _fk("dataset_security_marking", "dataset_id", "dataset"),
    _fk("dataset_security_marking", "security_marking_id", "security_marking"),
    _fk("role_assignment", "governance_role_id", "governance_role"),
    _fk("role_assignment", "person_id", "person"),
    _fk("role_assignment", "dataset_id", "dataset"),
    _fk("decision_log", "dataset_id", "dataset", "set null"),
    _fk("decision_log", "related_request", "data_access_request", "set null"),
    _fk("data_access_request", "dataset_id", "dataset"),
    _fk("data_access_request", "decision_log_id", "decision_log", "set null"),
    _fk("dataset_lineage", "upstream_dataset_id", "dataset"),
    _fk("dataset_lineage", "downstream_dataset_id", "dataset"),
    _fk("glossary_term", "stewardship_role_id", "governance_role", "set null"),
]
