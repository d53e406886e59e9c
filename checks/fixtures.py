"""Stand-in tables built from the given parquet tables.

One expression text per column serves Spark (``selectExpr``) and the comparison SQL,
so both start from the same rows. Only the inputs are shared, never the logic under test.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.sources.tables import values_df

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

# subtype per case type: two for TYPE 8, an unknown code for TYPE 7, none for TYPE 9 and 12
LOOKUP_ROWS = [
    ("TYPE 0", "D"), ("TYPE 1", "E"), ("TYPE 2", "PD"), ("TYPE 3", "PE"), ("TYPE 4", "PE, PD"),
    ("TYPE 5", "PD, PE"), ("TYPE 6", "X"), ("TYPE 7", "Q"), ("TYPE 8", "PD"), ("TYPE 8", "PE"), ("NA", "D"),
]

K = "cast(o_orderkey as varchar(20))"


def _every(n: int, value: str) -> str:
    """NA for one residue, else ``value``."""
    return f"case when o_orderkey % {n} = 0 then 'NA' else {value} end"


def _cases(divisor: int, values: list[str | None]) -> str:
    arms = " ".join(
        f"when {i} then {'null' if v is None else v}" for i, v in enumerate(values)
    )
    return f"case cast(floor(o_orderkey / {divisor}) as bigint) % {len(values)} {arms} end"


def _documents(prefix: str, party_type: str) -> list[str | None]:
    name = f"""'{{"Name":"{prefix} ', cast(o_custkey as varchar(20)), '","City":"X","State":"MD","Zip Code":"21502\""""
    address = ""","Address":"1 Main St","Address1":"Apt ', cast(o_custkey % 9 as varchar(20)), '","Amount":"Unit 2\""""
    first = (
        f"""{name}{address},"Party No.":"1","Party Type":"{party_type}","""
        f""""Business or Organization Name":"Org ', {K}, '","Removal Date":"01/05/2020"}}'"""
    )
    second = f"""{name},"Party No.":"2","Party Type":"{party_type}","Removal Date":"02/30/2020"}}'"""
    return [
        f"concat({first})", f"concat('[', {first}, ',', {second}, ']')",
        "'[]'", "'null'", "'{bad'", "'NA'", "''", None, "'[5]'",
    ]


_SRC = {
    "source_id": "o_orderkey",
    "load_id": "c_nationkey",
    "row_num": K,
    "id": K,
    "case_number": _every(17, f"concat('C-', {K})"),
    "caption": f"concat(c_name, ' matter number ', {K}, ' before the county court')",
    "name": "c_name",
    "dob": _every(19, "concat('19', cast(50 + o_orderkey % 50 as varchar(20)), '-01-02')"),
    "party_type": _every(23, "'Party'"),
    "court": "concat('County ', cast(c_nationkey as varchar(20)))",
    "court_id": "cast(c_nationkey as varchar(20))",
    "case_type": (
        "case when o_orderkey % 13 = 10 then 'NA' when o_orderkey % 13 = 11 then null "
        "else concat('TYPE ', cast(o_orderkey % 13 as varchar(20))) end"
    ),
    "filing_date": _cases(3, ["'2020-02-30'", "'NA'", "''", None] + ["substr(cast(o_orderdate as varchar(30)), 1, 10)"] * 2),
    "status": _every(29, "o_orderstatus"),
    "court_system": _cases(13, [
        "'CIVIL'", "'Civil System'", "'Criminal'", "'District Family'", "'TRAFFIC'", "'Probate'", None, "'CIVIL FAMILY'",
    ]),
    "checksum": f"concat('c', {K})",
    "misc": "'NA'",
    "last_scrape": "'NA'",
    "not_found_at": "'NA'",
    "created_at": _every(31, "'2022-09-28'"),
    "updated_at": _every(37, "'2022-09-29'"),
    "tracking_number": "'NA'",
    "case_type_code": "cast(o_orderkey % 13 as varchar(20))",
    "location": _every(41, "concat('Room ', cast(o_custkey % 7 as varchar(20)))"),
    "defendant": _cases(5, _documents("D", "Defendant")),
    "plaintiff": _cases(7, _documents("P", "Plaintiff")),
    "error": _every(43, "'none'"),
    "versions": _every(47, "cast(o_orderkey % 3 as varchar(20))"),
    "parser": "'p1'",
    "cjis": "case o_orderkey % 11 when 0 then 'C1' when 1 then '' when 2 then null else 'NA' end",
    "sentence_length": "'NA'",
}


class StandIn(NamedTuple):
    table: str
    columns: dict[str, str]
    where: str | None = None
    distinct: bool = False

    def sql(self) -> str:
        columns = ", ".join(f"{e} AS {c}" for c, e in self.columns.items())
        where = f" WHERE {self.where}" if self.where else ""
        return f"SELECT {'DISTINCT ' if self.distinct else ''}{columns} FROM {self.table}{where}"

    def frame(self, df: DataFrame) -> DataFrame:
        if self.where:
            df = df.where(self.where)
        df = df.selectExpr(*[f"{e} AS {c}" for c, e in self.columns.items()])
        return df.distinct() if self.distinct else df


def _text(expression: str) -> str:
    return f"cast({expression} as varchar(20))"


_DAY = "cast('2024-02-01' as date)"

GOV = {
    "agency": StandIn("nation", {
        "agency_id": "n_nationkey", "name": "n_name", "acronym": f"concat('N', {_text('n_nationkey')})",
        "description": "n_name", "contact_email": "lower(n_name)",
        "created_at": _DAY, "updated_at": _DAY,
    }),
    "dataset": StandIn("part", {
        "dataset_id": "p_partkey", "title": "p_name", "description": "p_type",
        "source_identifier": f"concat('part-', {_text('p_partkey')})",
        "agency_id": "case when p_partkey % 10 = 0 then null else cast(p_partkey % 27 as int) end",
        "created_at": _DAY, "updated_at": _DAY,
        "landing_page": f"concat('https://example.org/', {_text('p_partkey')})",
        "license": "p_brand", "public_access_level": "case when p_size % 3 = 0 then 'public' else 'restricted' end",
        "is_sensitive": "p_size > 40", "source_modified": _DAY, "harvest_timestamp": _DAY,
    }),
    "distribution": StandIn("part", {
        "distribution_id": f"concat('file-', {_text('p_partkey')})", "dataset_id": "p_partkey", "title": "p_name",
        "download_url": f"concat('https://example.org/', {_text('p_partkey')}, '.csv')", "format": "'csv'",
        "size_bytes": "cast(p_size as bigint)",
    }, where="p_size > 10"),
    "tag": StandIn("lineitem", {
        "tag_id": "l_linenumber", "name": f"concat('tag', {_text('l_linenumber')})",
        "description": "'line number'", "tag_type": "'keyword'",
    }, distinct=True),
    "dataset_tag": StandIn("lineitem", {
        "dataset_id": "l_partkey", "tag_id": "l_linenumber", "tag_source": "'data_gov'",
    }, where="l_quantity > 45", distinct=True),
    "security_marking": StandIn("lineitem", {
        "security_marking_id": "l_returnflag",
        "name": "case l_returnflag when 'A' then 'Public' when 'N' then 'CUI' else 'HVA' end",
        "classification_level": "case l_returnflag when 'A' then 'low' when 'N' then 'moderate' else 'high' end",
    }, distinct=True),
    "dataset_security_marking": StandIn("lineitem", {
        "dataset_id": "l_partkey", "security_marking_id": "l_returnflag",
    }, where="l_quantity < 3", distinct=True),
    "policy": StandIn("region", {"policy_id": "r_regionkey", "name": "r_name", "policy_type": "'privacy'"}),
    "dataset_policy": StandIn("lineitem", {
        "dataset_id": "l_partkey", "policy_id": "cast(l_suppkey % 5 as int)",
    }, where="l_linenumber = 7", distinct=True),
    "permissible_use": StandIn("nation", {
        "permissible_use_id": "n_nationkey", "policy_id": "n_regionkey", "use_case": "n_name",
        "description": "concat('use of ', n_name)", "requires_approval": "n_nationkey % 2 = 0",
        "approval_authority": "case when n_nationkey % 2 = 0 then 'Data Owner' end",
    }),
    "permissible_use_condition": StandIn("supplier", {
        "permissible_use_condition_id": "s_suppkey", "permissible_use_id": "s_nationkey",
        "dataset_id": "case when s_suppkey % 4 = 0 then null else s_suppkey end",
        "condition_text": "s_name", "condition_type": "'limit'",
        "condition_value": "case when s_suppkey % 3 = 0 then null else 'regional' end",
        "enforced_by": "'Privacy Officer'",
    }),
    "governance_role": StandIn("orders", {
        "governance_role_id": "o_orderpriority", "name": "upper(o_orderpriority)",
        "description": "concat('role ', o_orderpriority)", "responsibilities": "'review'",
        "authority_level": "'manager'",
    }, distinct=True),
    "person": StandIn("customer", {
        "person_id": "c_custkey", "full_name": "c_name",
        "email": (
            "case when c_custkey % 7 = 0 then null else concat(case when c_custkey % 2 = 0 then 'User' else 'user' end, "
            "cast(cast(floor(c_custkey / 2) as bigint) as varchar(20)), '@x.gov') end"
        ),
        "organization": "c_mktsegment", "notes": "concat('note ', c_name)",
    }),
    "role_assignment": StandIn("orders", {
        "role_assignment_id": "o_orderkey", "governance_role_id": "o_orderpriority", "person_id": "o_custkey",
        "dataset_id": "case when o_orderkey % 4 = 0 then null else o_orderkey % 2100 end",
        "scope": "case when o_orderkey % 4 = 0 then 'enterprise' else 'dataset' end",
        "start_date": "cast(o_orderdate as date)", "end_date": "cast(null as date)",
        "assigned_by": "'Chief Data Officer'", "notes": "'monthly'",
    }),
    "decision_log": StandIn("orders", {
        "decision_log_id": "o_orderkey", "dataset_id": "o_orderkey % 2000",
        "decision_type": "case o_orderstatus when 'F' then 'approved' else 'denied' end",
        "decision_text": f"concat('decision ', {K})", "decided_by": "o_orderpriority",
        "decided_on": "cast(o_orderdate as date)", "related_request": "o_orderkey",
    }, where="o_orderstatus <> 'O'"),
    "data_access_request": StandIn("orders", {
        "request_id": "o_orderkey", "dataset_id": "o_orderkey % 2000",
        "requested_by": f"concat('c', {_text('o_custkey')})", "requested_on": "cast(o_orderdate as date)",
        "purpose": "o_orderpriority",
        "status": "case when o_orderkey % 50 = 0 then 'unknown' else 'pending' end",
        "decision_log_id": "case when o_orderstatus = 'O' then null else o_orderkey end",
    }),
    "dataset_lineage": StandIn("part", {
        "dataset_lineage_id": "p_partkey", "upstream_dataset_id": "cast(floor(p_partkey / 2) as bigint)",
        "downstream_dataset_id": "p_partkey", "lineage_type": "'view'",
    }, where="p_partkey > 0"),
    "file_load": StandIn("nation", {
        "load_id": "n_nationkey",
        "file_name": (
            "case when n_nationkey % 5 = 0 then concat(n_name, '.csv') when n_nationkey % 2 = 0 "
            "then 'Court Data_20220928_Alder County Circuit Court.csv' "
            "else 'Court Data_20220928_Birch County Circuit Court.csv' end"
        ),
        "file_size_bytes": "cast(1000 + n_nationkey as bigint)", "rows_loaded": "cast(n_regionkey as bigint)",
        "load_started_at": "cast(concat('2022-09-28 10:00:', cast(10 + n_nationkey as varchar(20))) as timestamp)",
        "load_completed_at": (
            "case when n_nationkey % 3 = 1 then cast(concat('2022-09-28 10:', cast(10 + n_nationkey as varchar(20)), "
            "':05') as timestamp) end"
        ),
        "load_status": "case n_nationkey % 3 when 0 then 'started' when 1 then 'completed' else 'failed' end",
        "error_message": "case when n_nationkey % 3 = 2 then 'Copy command failed' end",
    }),
}


class Data:
    """The given tables of one scale folder and the stand-ins built from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def ct(self) -> DataFrame:
        return values_df(self.spark, LOOKUP_ROWS, "case_type string, subtype string")

    def src(self, files: int | None = None) -> DataFrame:
        """The case rows; dealt by their id and name over ``files`` tasks, before the wide columns are made."""
        orders = self.table("orders") if files else self.table("orders").repartition("o_orderkey")
        joined = orders.join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
        if files:
            joined = joined.repartition(files, F.expr(_SRC["id"]), F.expr(_SRC["name"]))
        return joined.selectExpr(*[f"{e} AS {c}" for c, e in _SRC.items()])

    def amended(self) -> DataFrame:
        """Case rows followed by later versions of some of them, which arrive with another load."""
        src = self.src()
        later = src.where("status = 'F'").withColumns({
            "source_id": F.col("source_id") + F.lit(10**12),
            "load_id": (F.col("load_id") + 1) % 25,
            "caption": F.concat("caption", F.lit(" amended")),
        })
        return src.unionByName(later)

    def gov(self, name: str) -> DataFrame:
        stand_in = GOV[name]
        return stand_in.frame(self.table(stand_in.table))

    def govs(self, *names: str) -> dict[str, DataFrame]:
        return {n: self.gov(n) for n in names}


# --- the same stand-ins, and the steps that the comparison SQL shares, as named subqueries ---

_EXPRESSIONS = ", ".join(f"{e} AS {c}" for c, e in _SRC.items())
_LOOKUP = ", ".join(f"('{a}', '{b}')" for a, b in LOOKUP_ROWS)
CIVIL = "('D', 'E', 'PE', 'PD', 'PE, PD', 'PD, PE')"
_CLEANED = [
    c for c in _SRC if c not in ("source_id", "load_id", "row_num", "id", "created_at", "updated_at", "error")
]
NA_REPLACED = "* REPLACE (" + ", ".join(f"nullif({c}, 'NA') AS {c}" for c in _CLEANED) + ")"
NA_EMPTY_REPLACED = "* REPLACE (" + ", ".join(f"nullif(nullif({c}, 'NA'), '') AS {c}" for c in _CLEANED) + ")"
KEPT_SYSTEM = " AND ".join(
    f"(court_system IS NULL OR upper(court_system) NOT LIKE '%{w}%')" for w in ("CRIMINAL", "FAMILY", "TRAFFIC", "PROBATE")
)
LABEL = (
    "CASE subtype WHEN 'PE, PD' THEN 'UNDETERMINED' WHEN 'PD, PE' THEN 'UNDETERMINED' WHEN 'D' THEN 'DEBT' "
    "WHEN 'E' THEN 'EVICTION' WHEN 'PD' THEN 'POSSIBLE DEBT' WHEN 'PE' THEN 'POSSIBLE EVICTION' {rest} END"
)
ISO_DATE = r"CAST(CAST(try_strptime(regexp_extract(filing_date, '^\s*(\d{1,4}-\d{1,2}-\d{1,2})', 1), '%Y-%m-%d') AS DATE) AS VARCHAR)"
CASE_COLUMNS = (
    f"CAST(id AS BIGINT) AS row_id, case_number, caption, name, dob AS birth_date, party_type AS role, court, "
    f"case_type, {ISO_DATE} AS file_date, status AS case_status, court_system, created_at AS create_date, "
    f"updated_at AS update_date, location AS court_location, versions, clear_type AS category"
)
_PARTY = ", ".join(
    f"e->>'$.\"{key}\"' AS {out}" for out, key in (
        ("name", "Name"), ("city", "City"), ("state", "State"), ("zip", "Zip Code"), ("address", "Address"),
        ("address_ln1", "Address1"), ("address_ln2", "Amount"), ("party_num", "Party No."), ("role", "Party Type"),
        ("org_name", "Business or Organization Name"),
    )
)


def party_sql(rows: str, column: str) -> str:
    """Party rows of the documents in ``column`` of subquery ``rows``."""
    return f"""SELECT row_id, {_PARTY},
        CAST(CAST(try_strptime(e->>'$."Removal Date"', '%m/%d/%Y') AS DATE) AS VARCHAR) AS removal_date
      FROM (
        SELECT row_id, unnest(CASE WHEN json_type(j) = 'ARRAY' THEN from_json(j, '["JSON"]') ELSE [j] END) AS e
        FROM (SELECT CAST(id AS BIGINT) AS row_id, CAST({column} AS JSON) AS j FROM {rows}
              WHERE {column} IS NOT NULL AND {column} <> 'NA' AND {column} <> '' AND json_valid({column})))"""


SUBQUERIES: dict[str, str] = {
    "src": f"SELECT {_EXPRESSIONS} FROM orders JOIN customer ON o_custkey = c_custkey",
    "ct": f"SELECT * FROM (VALUES {_LOOKUP}) AS v(case_type, subtype)",
    **{f"gov_{name}": stand_in.sql() for name, stand_in in GOV.items()},
    "labelled": "SELECT s.*, c.subtype FROM src s LEFT JOIN ct c ON s.case_type = c.case_type",
    "civil": f"SELECT *, {LABEL.format(rest='')} AS clear_type FROM labelled WHERE subtype IN {CIVIL}",
    "civil_nulls": f"SELECT {NA_REPLACED} FROM civil",
    "branch_a": f"SELECT * FROM civil_nulls WHERE {KEPT_SYSTEM} AND cjis IS NULL",
    "non_civil": (
        "SELECT *, CASE WHEN subtype = 'X' THEN 'OTHER CIVIL' ELSE 'NO INFORMATION' END AS clear_type "
        f"FROM labelled WHERE subtype IS NULL OR subtype NOT IN {CIVIL}"
    ),
    "branch_b": f"SELECT {NA_REPLACED} FROM non_civil",
    "branch_b1": "SELECT * FROM branch_b WHERE court_system LIKE '%CIVIL%'",
    "branch_b2": "SELECT * FROM branch_b WHERE court_system NOT LIKE '%CIVIL%' AND upper(court_system) LIKE '%CIVIL%'",
    "cases_a": f"SELECT DISTINCT {CASE_COLUMNS} FROM branch_a",
    "cases_b1": f"SELECT DISTINCT {CASE_COLUMNS} FROM branch_b1",
    "cases_b2": f"SELECT DISTINCT {CASE_COLUMNS} FROM branch_b2",
    "final_cases": "SELECT * FROM cases_a UNION ALL SELECT * FROM cases_b1 UNION ALL SELECT * FROM cases_b2",
    "party_rows": "SELECT id, defendant, plaintiff FROM branch_a UNION ALL SELECT id, defendant, plaintiff FROM branch_b1",
    "amended_src": (
        "SELECT * FROM src UNION ALL SELECT * REPLACE (source_id + 1000000000000 AS source_id, (load_id + 1) % 25 AS load_id, "
        "concat(caption, ' amended') AS caption) FROM src WHERE status = 'F'"
    ),
    "load_runs": (
        "SELECT load_id, CASE WHEN load_status = 'started' OR rows_loaded < 3 THEN 1 ELSE 2 END AS run FROM gov_file_load "
        "WHERE load_status IN ('started', 'completed')"
    ),
    "amended_labelled": (
        "SELECT s.*, r.run, c.subtype FROM amended_src s JOIN load_runs r ON r.load_id = s.load_id "
        "LEFT JOIN ct c ON s.case_type = c.case_type"
    ),
    "accepted_v2": (
        f"SELECT {NA_EMPTY_REPLACED} FROM (SELECT *, "
        + LABEL.format(rest="WHEN 'X' THEN 'OTHER CIVIL' ELSE CASE WHEN subtype IS NULL THEN 'NO INFORMATION' ELSE 'UNKNOWN' END")
        + " AS clear_type FROM amended_labelled)"
    ),
    "accepted_v1": f"SELECT * FROM accepted_v2 WHERE subtype IN {CIVIL}",
    **{
        f"processed_{v}": (
            f"SELECT source_id, load_id, {CASE_COLUMNS} FROM accepted_{v} WHERE {KEPT_SYSTEM} AND cjis IS NULL "
            "QUALIFY row_number() OVER (PARTITION BY CAST(id AS BIGINT) ORDER BY run, source_id, clear_type) = 1"
        )
        for v in ("v1", "v2")
    },
    "first_run_loads": (
        f"SELECT DISTINCT load_id FROM (SELECT load_id FROM accepted_v2 WHERE run = 1 AND {KEPT_SYSTEM} AND cjis IS NULL "
        "QUALIFY row_number() OVER (PARTITION BY CAST(id AS BIGINT) ORDER BY source_id, clear_type) = 1)"
    ),
    **{
        f"second_run_{v}": (
            "SELECT s.* FROM amended_src s JOIN load_runs r ON r.load_id = s.load_id WHERE r.run = 2 "
            f"AND CAST(s.id AS BIGINT) IN (SELECT row_id FROM processed_{v})"
        )
        for v in ("v1", "v2")
    },
    "final_defendants": party_sql("party_rows", "defendant"),
    "final_plaintiffs": party_sql("party_rows", "plaintiff"),
}


def with_subqueries(body: str) -> str:
    """``body`` preceded by every subquery it (or one of those) names as a whole word."""
    needed: list[str] = []

    def need(text: str) -> None:
        for name, sql in SUBQUERIES.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                need(sql)
                if name not in needed:
                    needed.append(name)

    need(body)
    if not needed:
        return body
    own = body.removeprefix("WITH ")
    named = ",\n".join(f"{n} AS ({SUBQUERIES[n]})" for n in needed)
    return f"WITH RECURSIVE {named}" + (f",\n{own}" if own != body else f"\n{body}")
