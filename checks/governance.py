"""Governance views, merges and enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query
from recordloom.functions import content_hash, court_from_filename, surrogate_key
from recordloom.functions.dates import seconds_between
from recordloom.operators import aggregates, merge
from recordloom.operators.quality import union_all
from recordloom.plans import enrichment, governance
from recordloom.session import stage
from recordloom.plans.sql_names import governance_views, register_views
from recordloom.plans.loads import stamp_load, start_loads
from recordloom.schemas import GOVERNANCE_FOREIGN_KEYS, LEDGER_SCHEMA
from recordloom.sources.tables import values_df

_CATALOG = ("dataset", "agency", "dataset_tag", "tag", "dataset_security_marking", "security_marking", "dataset_policy", "policy")


def _names(alias: str, bridge: str, dim: str, key: str) -> str:
    return f"""(SELECT string_agg(name, '|' ORDER BY name) FROM (SELECT DISTINCT x.name FROM gov_{bridge} b
               JOIN gov_{dim} x ON x.{key} = b.{key} WHERE b.dataset_id = d.dataset_id)) AS {alias}"""


# --- views -----------------------------------------------------------------------------------

@query(f"""SELECT d.dataset_id, d.title, d.description, d.source_identifier, a.name AS agency_name, a.acronym AS agency_acronym,
                  d.landing_page, d.license, d.public_access_level, d.is_sensitive,
                  CAST(d.source_modified AS VARCHAR) AS source_modified, CAST(d.harvest_timestamp AS VARCHAR) AS harvest_timestamp,
                  {_names('tags', 'dataset_tag', 'tag', 'tag_id')},
                  {_names('security_markings', 'dataset_security_marking', 'security_marking', 'security_marking_id')},
                  {_names('policies', 'dataset_policy', 'policy', 'policy_id')}
           FROM gov_dataset d LEFT JOIN gov_agency a ON a.agency_id = d.agency_id""")
def catalog_dataset_view(d):
    return governance.catalog_dataset(d.govs(*_CATALOG))


_CONDITIONS = """SELECT u.permissible_use_id, u.policy_id, p.name AS policy_name, u.use_case, u.description, u.requires_approval,
       u.approval_authority, c.conditions
     FROM gov_permissible_use u LEFT JOIN gov_policy p ON p.policy_id = u.policy_id
     LEFT JOIN (
       SELECT permissible_use_id, string_agg(j, '|' ORDER BY s) AS conditions FROM (
         SELECT permissible_use_id, permissible_use_condition_id AS s,
           CAST(json_object('dataset_id', dataset_id, 'condition_type', condition_type, 'condition_value', condition_value,
                            'condition_text', condition_text, 'enforced_by', enforced_by) AS VARCHAR) AS j
         FROM gov_permissible_use_condition) GROUP BY permissible_use_id) c
     ON c.permissible_use_id = u.permissible_use_id"""


@query(_CONDITIONS)
def permissible_use_view(d):
    view = governance.permissible_use(d.govs("permissible_use", "permissible_use_condition", "policy"))
    by_text = F.array_sort(
        "conditions", lambda a, b: F.when(a["condition_text"] < b["condition_text"], -1).when(a["condition_text"] > b["condition_text"], 1).otherwise(0)
    )
    texts = F.transform(by_text, lambda c: F.to_json(c, {"ignoreNullFields": "false"}))
    return view.withColumn("conditions", texts)


@query("""SELECT ra.role_assignment_id, gr.name AS role_name, gr.description AS role_description, gr.responsibilities, ra.scope,
                 CAST(ra.start_date AS VARCHAR) AS start_date, CAST(ra.end_date AS VARCHAR) AS end_date, ra.assigned_by, ra.notes,
                 p.full_name, p.email, p.organization, d.dataset_id, d.title AS dataset_title
          FROM gov_role_assignment ra JOIN gov_governance_role gr ON gr.governance_role_id = ra.governance_role_id
          JOIN gov_person p ON p.person_id = ra.person_id LEFT JOIN gov_dataset d ON d.dataset_id = ra.dataset_id""")
def governance_assignments_view(d):
    return governance.governance_assignments(d.govs("role_assignment", "governance_role", "person", "dataset"))


@query("""SELECT r.request_id, d.dataset_id, d.title AS dataset_title, r.requested_by, CAST(r.requested_on AS VARCHAR) AS requested_on,
                 r.purpose, r.status, l.decision_type, l.decision_text, l.decided_by, CAST(l.decided_on AS VARCHAR) AS decided_on
          FROM gov_data_access_request r LEFT JOIN gov_dataset d ON d.dataset_id = r.dataset_id
          LEFT JOIN gov_decision_log l ON l.decision_log_id = r.decision_log_id""")
def data_access_requests_view(d):
    return governance.data_access_requests(d.govs("data_access_request", "dataset", "decision_log"))


@query("""SELECT dataset_id, string_agg(name, '|' ORDER BY name) AS names FROM (
            SELECT DISTINCT b.dataset_id, t.name FROM gov_dataset_tag b JOIN gov_tag t ON t.tag_id = b.tag_id) GROUP BY dataset_id""")
def distinct_names_array(d):
    return aggregates.distinct_names_by(d.gov("dataset_tag"), d.gov("tag"), "dataset_id", "tag_id", "names")


@query("""SELECT permissible_use_id, count(*) AS conditions, count(dataset_id) AS datasets, min(condition_text) AS first_text,
                 max(condition_text) AS last_text, true AS in_order FROM gov_permissible_use_condition GROUP BY permissible_use_id""")
def spread_condition_arrays(d):
    """Conditions of a use in three arrays: together they hold every condition once."""
    parts = aggregates.collect_parts_by(
        d.gov("permissible_use_condition"), "permissible_use_id", "permissible_use_condition_id",
        F.struct("dataset_id", "condition_text"), "conditions", parts=3,
    )
    each = parts.select("permissible_use_id", "part", F.explode("conditions").alias("c"))
    return each.groupBy("permissible_use_id").agg(
        F.count("*").alias("conditions"), F.count("c.dataset_id").alias("datasets"),
        F.min("c.condition_text").alias("first_text"), F.max("c.condition_text").alias("last_text"),
        F.every(F.col("part").between(0, 2)).alias("in_order"),
    )


@query("""SELECT u.permissible_use_id, u.policy_id, p.name AS policy_name, u.use_case, u.description, u.requires_approval,
                 u.approval_authority, c.permissible_use_condition_id, c.dataset_id, c.condition_type, c.condition_value,
                 c.condition_text, c.enforced_by
          FROM gov_permissible_use u LEFT JOIN gov_policy p ON p.policy_id = u.policy_id
          LEFT JOIN gov_permissible_use_condition c ON c.permissible_use_id = u.permissible_use_id""")
def permissible_use_rows(d):
    return governance.permissible_use_conditions(d.govs("permissible_use", "policy", "permissible_use_condition"))


@query("""SELECT d.dataset_id, d.title, d.agency_id, a.name AS agency_name, x.tags FROM gov_dataset d
          LEFT JOIN gov_agency a ON a.agency_id = d.agency_id
          LEFT JOIN (SELECT dataset_id, count(DISTINCT tag_id) AS tags FROM gov_dataset_tag GROUP BY dataset_id) x ON x.dataset_id = d.dataset_id""")
def group_by_primary_key(d):
    """Grouping by the key alone; the columns the key implies are joined back."""
    tags = d.gov("dataset_tag").groupBy("dataset_id").agg(F.countDistinct("tag_id").alias("tags"))
    agency = d.gov("agency").select("agency_id", F.col("name").alias("agency_name"))
    return d.gov("dataset").join(tags, "dataset_id", "left").join(agency, "agency_id", "left").select(
        "dataset_id", "title", "agency_id", "agency_name", "tags"
    )


# --- joins of the enrichment -----------------------------------------------------------------

@query("""SELECT c.c_custkey, c.c_name, v.line FROM customer c
          JOIN (VALUES ('BUILDING', 'trade'), ('MACHINERY', 'industry'), ('HOUSEHOLD', 'retail')) AS v(c_mktsegment, line)
          ON v.c_mktsegment = c.c_mktsegment""")
def join_constant_relation(d):
    lines = values_df(
        d.spark, [("BUILDING", "trade"), ("MACHINERY", "industry"), ("HOUSEHOLD", "retail")], "c_mktsegment string, line string"
    )
    return d.table("customer").join(lines, "c_mktsegment").select("c_custkey", "c_name", "line")


@query("""SELECT c.permissible_use_condition_id, u.use_case, p.name AS policy_name FROM gov_permissible_use_condition c
          JOIN gov_permissible_use u ON u.permissible_use_id = c.permissible_use_id
          JOIN gov_policy p ON p.policy_id = u.policy_id AND p.name = 'ASIA'""")
def join_with_constant_predicate(d):
    policy = d.gov("policy").where(F.col("name") == "ASIA").select("policy_id", F.col("name").alias("policy_name"))
    uses = d.gov("permissible_use").join(policy, "policy_id")
    return d.gov("permissible_use_condition").join(uses, "permissible_use_id").select(
        "permissible_use_condition_id", "use_case", "policy_name"
    )


@query("""SELECT p.person_id, q.person_id AS other_id, lower(p.email) AS email FROM gov_person p
          JOIN (SELECT c_custkey AS person_id, concat('USER', cast(c_custkey as varchar), '@X.gov') AS email FROM customer) q
          ON lower(p.email) = lower(q.email)""")
def join_on_lower_email(d):
    other = d.table("customer").select(
        F.col("c_custkey").alias("other_id"),
        F.lower(F.concat(F.lit("USER"), F.col("c_custkey").cast("string"), F.lit("@X.gov"))).alias("email"),
    )
    return d.gov("person").select("person_id", F.lower("email").alias("email")).join(other, "email")


def _wanted(d):
    """Tag names wanted per dataset, derived from the line items of its part."""
    return d.table("lineitem").where(F.col("l_quantity") > 40).select(
        F.concat(F.lit("part-"), F.col("l_partkey").cast("string")).alias("source_identifier"),
        F.concat(F.lit("tag"), F.col("l_linenumber").cast("string")).alias("name"),
    )


_WANTED_TAGS = """SELECT DISTINCT d.dataset_id, t.tag_id, 'governance' AS tag_source FROM lineitem l
    JOIN gov_dataset d ON d.source_identifier = concat('part-', cast(l.l_partkey as varchar))
    JOIN gov_tag t ON t.name = concat('tag', cast(l.l_linenumber as varchar)) WHERE l.l_quantity > 40"""


@query(f"SELECT * FROM gov_dataset_tag UNION ALL {_WANTED_TAGS}")
def assign_tags(d):
    return enrichment.assign_tags(d.govs("dataset", "tag", "dataset_tag"), _wanted(d))


# --- merges ----------------------------------------------------------------------------------

@query("""WITH batch AS (SELECT cast(1000 + n_nationkey as int) AS tag_id, concat(CASE WHEN n_nationkey % 2 = 0 THEN 'TAG' ELSE 'Tag' END,
              cast(n_regionkey * 3 as varchar)) AS name, n_name AS description, 'keyword' AS tag_type FROM nation)
          SELECT tag_id, name, description, tag_type FROM gov_tag UNION ALL
          (SELECT * FROM batch WHERE lower(name) NOT IN (SELECT lower(name) FROM gov_tag)
           QUALIFY row_number() OVER (PARTITION BY lower(name) ORDER BY tag_id) = 1)""")
def insert_ignore_by_name(d):
    prefix = F.when(F.col("n_nationkey") % 2 == 0, "TAG").otherwise("Tag")
    source = d.table("nation").select(
        (F.lit(1000) + F.col("n_nationkey")).alias("tag_id"),
        F.concat(prefix, (F.col("n_regionkey") * 3).cast("string")).alias("name"),
        F.col("n_name").alias("description"),
        F.lit("keyword").alias("tag_type"),
    )
    return merge.insert_ignore(d.gov("tag"), source, [F.lower("name"), "tag_type"], ["tag_id"])


@query("""SELECT * FROM gov_dataset_tag UNION ALL
          SELECT DISTINCT l_partkey, l_linenumber, 'data_gov' FROM lineitem l WHERE l_quantity > 30 AND NOT EXISTS (
            SELECT 1 FROM gov_dataset_tag t WHERE t.dataset_id = l.l_partkey AND t.tag_id = l.l_linenumber)""")
def insert_ignore_composite_key(d):
    source = d.table("lineitem").where(F.col("l_quantity") > 30).select(
        F.col("l_partkey").alias("dataset_id"), F.col("l_linenumber").alias("tag_id"), F.lit("data_gov").alias("tag_source")
    )
    return merge.insert_ignore(d.gov("dataset_tag"), source, ["dataset_id", "tag_id", "tag_source"])


def _dataset_batch(d):
    """Two thirds known datasets with new values, the rest new ones."""
    s = d.table("part").select(
        (F.col("p_partkey") * 2).alias("dataset_id"),
        F.concat(F.lit("part-"), (F.col("p_partkey") * 2).cast("string")).alias("source_identifier"),
        F.upper("p_name").alias("title"), F.col("p_brand").alias("description"),
        F.lit(3).alias("agency_id"), F.lit(None).cast("string").alias("landing_page"),
        F.lit("open").alias("license"), F.lit("public").alias("public_access_level"),
        F.lit(True).alias("is_sensitive"), F.lit(None).cast("date").alias("source_modified"),
    )
    return s


@query("""WITH batch AS (SELECT p_partkey * 2 AS dataset_id, concat('part-', cast(p_partkey * 2 as varchar)) AS source_identifier,
            upper(p_name) AS title, p_brand AS description FROM part)
          SELECT d.dataset_id, d.source_identifier, coalesce(b.title, d.title) AS title, coalesce(b.description, d.description) AS description,
            CASE WHEN b.dataset_id IS NULL THEN d.agency_id ELSE 3 END AS agency_id,
            CASE WHEN b.dataset_id IS NULL THEN d.landing_page END AS landing_page,
            CASE WHEN b.dataset_id IS NULL THEN d.license ELSE 'open' END AS license, d.is_sensitive,
            CASE WHEN b.dataset_id IS NULL THEN '2024-02-01' ELSE '2024-03-01' END AS updated_at,
            CAST(d.created_at AS VARCHAR) AS created_at, CAST(d.source_modified AS VARCHAR) AS source_modified
          FROM gov_dataset d LEFT JOIN batch b ON b.source_identifier = d.source_identifier
          UNION ALL
          SELECT b.dataset_id, b.source_identifier, b.title, b.description, 3, NULL, 'open', true, '2024-03-01', '2024-03-01', NULL
          FROM batch b WHERE NOT EXISTS (SELECT 1 FROM gov_dataset d WHERE d.source_identifier = b.source_identifier)""")
def upsert_partial_columns(d):
    return enrichment.upsert_dataset(d.gov("dataset"), _dataset_batch(d), "2024-03-01").select(
        "dataset_id", "source_identifier", "title", "description", "agency_id", "landing_page", "license",
        "is_sensitive", "updated_at", "created_at", "source_modified",
    )


@query("""SELECT a.agency_id, a.name, coalesce(r.r_name, a.acronym) AS acronym,
                 CASE WHEN r.r_name IS NULL THEN '2024-02-01' ELSE '2024-03-01' END AS updated_at
          FROM gov_agency a LEFT JOIN region r ON lower(a.name) = lower(concat('Nation_', cast(r.r_regionkey as varchar)))
          UNION ALL SELECT CAST(s_suppkey + 100 AS INTEGER), s_name, 'S', '2024-03-01' FROM supplier""")
def upsert_agency_by_name(d):
    known = d.table("region").select(
        F.col("r_regionkey").cast("bigint").alias("agency_id"),
        F.concat(F.lit("Nation_"), F.col("r_regionkey").cast("string")).alias("name"), F.col("r_name").alias("acronym"),
    )
    new = d.table("supplier").select((F.col("s_suppkey") + 100).alias("agency_id"), F.col("s_name").alias("name"), F.lit("S").alias("acronym"))
    rows = known.unionByName(new).withColumns({"description": F.lit("d"), "contact_email": F.lit("e")})
    return enrichment.upsert_agency(d.gov("agency"), rows, "2024-03-01").select("agency_id", "name", "acronym", "updated_at")


@query("""WITH old AS (SELECT file_name, min(load_id) AS load_id, max(rows_loaded) AS rows_loaded FROM gov_file_load GROUP BY file_name),
          files AS (SELECT DISTINCT file_name FROM gov_file_load WHERE load_id > 3 UNION SELECT concat(s_name, '.csv') FROM supplier)
          SELECT o.load_id, o.file_name, o.rows_loaded, CASE WHEN f.file_name IS NULL THEN 'completed' ELSE 'started' END AS load_status,
                 CASE WHEN f.file_name IS NULL THEN '2022-01-01 00:00:00' ELSE '2024-03-01 00:00:00' END AS load_started_at
          FROM old o LEFT JOIN files f ON f.file_name = o.file_name
          UNION ALL
          SELECT (SELECT max(load_id) FROM old) + row_number() OVER (ORDER BY file_name), file_name, NULL, 'started', '2024-03-01 00:00:00'
          FROM files WHERE file_name NOT IN (SELECT file_name FROM old)""")
def upsert_ledger(d):
    old = d.gov("file_load").groupBy("file_name").agg(
        F.min("load_id").cast("bigint").alias("load_id"), F.max("rows_loaded").alias("rows_loaded")
    ).withColumns({"load_status": F.lit("completed"), "load_started_at": F.lit("2022-01-01").cast("timestamp_ntz")})
    ledger = old.select(*[
        (F.col(f.name) if f.name in old.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in LEDGER_SCHEMA.fields
    ])
    files = (
        d.gov("file_load").where(F.col("load_id") > 3).select("file_name")
        .union(d.table("supplier").select(F.concat(F.col("s_name"), F.lit(".csv")))).distinct()
        .withColumns({"file_path": F.lit("p"), "file_size_bytes": F.lit(1).cast("bigint")})
    )
    return start_loads(ledger, files, "2024-03-01").select("load_id", "file_name", "rows_loaded", "load_status", "load_started_at")


_CONDITION_BATCH = """SELECT s_suppkey + 1000 AS id, n_nationkey AS use_id, s_suppkey AS dataset_id FROM supplier JOIN nation ON s_nationkey = n_nationkey"""


@query(f"""SELECT permissible_use_condition_id, permissible_use_id, dataset_id, condition_type, condition_value FROM gov_permissible_use_condition
          UNION ALL SELECT id, use_id, dataset_id, 'limit', 'regional' FROM ({_CONDITION_BATCH}) b WHERE NOT EXISTS (
            SELECT 1 FROM gov_permissible_use_condition c WHERE c.permissible_use_id = b.use_id AND c.dataset_id = b.dataset_id
              AND c.condition_type = 'limit' AND c.condition_value = 'regional')""")
def insert_where_absent(d):
    batch = d.table("supplier").select(
        (F.col("s_suppkey") + 1000).alias("permissible_use_condition_id"), F.col("s_nationkey").alias("permissible_use_id"),
        F.col("s_suppkey").alias("dataset_id"), F.lit("limit").alias("condition_type"), F.lit("regional").alias("condition_value"),
    )
    return enrichment.add_conditions(d.govs("permissible_use_condition"), batch).select(
        "permissible_use_condition_id", "permissible_use_id", "dataset_id", "condition_type", "condition_value"
    )


@query("""SELECT p.person_id, CASE WHEN s.s_suppkey IS NULL THEN p.full_name ELSE s.s_name END AS full_name, p.email, p.notes
          FROM gov_person p LEFT JOIN supplier s ON lower(p.email) = concat('user', cast(s.s_suppkey as varchar), '@x.gov')
          UNION ALL
          SELECT -s_suppkey, s_name, concat('USER', cast(s_suppkey as varchar), '@x.gov'), NULL FROM supplier
          WHERE concat('user', cast(s_suppkey as varchar), '@x.gov') NOT IN (SELECT lower(email) FROM gov_person WHERE email IS NOT NULL)""")
def update_else_insert(d):
    rows = d.table("supplier").select(
        (-F.col("s_suppkey")).alias("person_id"), F.col("s_name").alias("full_name"),
        F.concat(F.lit("USER"), F.col("s_suppkey").cast("string"), F.lit("@x.gov")).alias("email"), F.lit("org").alias("organization"),
    )
    return enrichment.upsert_person(d.gov("person"), rows).select("person_id", "full_name", "email", "notes")


@query("SELECT id, coalesce(CASE WHEN load_id % 2 = 0 THEN load_id END, 77) AS load_id FROM src")
def update_where_null(d):
    rows = d.src().select("id", F.when(F.col("load_id") % 2 == 0, F.col("load_id")).alias("load_id"))
    return stamp_load(rows, 77)


@query("""WITH lines AS (SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem),
          old AS (SELECT o_orderkey AS l_orderkey, 0 AS l_linenumber, -1 AS l_partkey FROM orders WHERE o_orderstatus = 'F')
          SELECT * FROM old UNION ALL
          SELECT * FROM lines WHERE l_orderkey NOT IN (SELECT l_orderkey FROM old)
          QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) = 1""")
def first_wins_insert(d):
    old = d.table("orders").where(F.col("o_orderstatus") == "F").select(
        F.col("o_orderkey").alias("l_orderkey"), F.lit(0).alias("l_linenumber"), F.lit(-1).cast("bigint").alias("l_partkey")
    )
    lines = d.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return merge.first_wins(old, lines, "l_orderkey", ["l_linenumber", "l_partkey"])


_DELETABLE = ("dataset", "dataset_tag", "role_assignment", "decision_log", "data_access_request", "permissible_use_condition")


@query("""WITH doomed AS (SELECT dataset_id FROM gov_dataset WHERE is_sensitive),
          requests AS (SELECT * FROM gov_data_access_request WHERE dataset_id NOT IN (SELECT dataset_id FROM doomed))
          SELECT 'dataset' AS tbl, count(*) AS rows_left, count(*) AS refs FROM gov_dataset WHERE dataset_id NOT IN (SELECT dataset_id FROM doomed)
          UNION ALL SELECT 'dataset_tag', count(*), count(*) FROM gov_dataset_tag WHERE dataset_id NOT IN (SELECT dataset_id FROM doomed)
          UNION ALL SELECT 'role_assignment', count(*), count(dataset_id) FROM gov_role_assignment
            WHERE dataset_id IS NULL OR dataset_id NOT IN (SELECT dataset_id FROM doomed)
          UNION ALL SELECT 'decision_log', count(*), count(CASE WHEN dataset_id NOT IN (SELECT dataset_id FROM doomed) THEN 1 END)
            + 1000000 * count(CASE WHEN related_request IN (SELECT request_id FROM requests) THEN 1 END) FROM gov_decision_log
          UNION ALL SELECT 'data_access_request', count(*), count(dataset_id) FROM requests
          UNION ALL SELECT 'permissible_use_condition', count(*), count(dataset_id) FROM gov_permissible_use_condition
            WHERE dataset_id IS NULL OR dataset_id NOT IN (SELECT dataset_id FROM doomed)""")
def delete_propagate(d):
    t = d.govs(*_DELETABLE)
    after = merge.delete_propagate(
        t, GOVERNANCE_FOREIGN_KEYS, "dataset", t["dataset"].where("is_sensitive").select("dataset_id")
    )
    refs = F.count("dataset_id")
    with_requests = refs + F.lit(1000000) * F.count("related_request")
    return union_all([
        after[n].agg(F.count("*").alias("rows_left"), (with_requests if n == "decision_log" else refs).alias("refs"))
        .select(F.lit(n).alias("tbl"), "rows_left", "refs")
        for n in _DELETABLE
    ])


def _text_ids(df, *columns):
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


@query("""SELECT 'governance_role' AS tbl, name AS a, name AS b, false AS seeded FROM gov_governance_role
          UNION ALL SELECT 'policy', name, policy_type, false FROM gov_policy
          UNION ALL SELECT 'security_marking', name, classification_level, false FROM gov_security_marking
          UNION ALL SELECT 'permissible_use', use_case, p.name, false FROM gov_permissible_use u JOIN gov_policy p ON p.policy_id = u.policy_id
          UNION ALL SELECT tbl, a, b, true FROM (VALUES ('governance_role', 'Data Owner', 'Data Owner'), ('governance_role', 'Data Steward', 'Data Steward'),
            ('governance_role', 'Privacy Officer', 'Privacy Officer'), ('governance_role', 'Security Officer', 'Security Officer'),
            ('governance_role', 'Data Governance Council Chair', 'Data Governance Council Chair'),
            ('policy', 'Privacy Act of 1974', 'privacy'), ('policy', 'CIPSEA Confidentiality', 'privacy'), ('policy', 'OMB M-19-23 FDS Strategy', 'governance'),
            ('policy', 'FedRAMP High Baseline', 'cybersecurity'), ('policy', 'Records Retention Schedule', 'retention'),
            ('security_marking', 'Controlled Unclassified Information', 'moderate'), ('security_marking', 'High-Value Asset', 'high'),
            ('permissible_use', 'Program service delivery', 'Privacy Act of 1974'),
            ('permissible_use', 'Statistical analysis with de-identification', 'Privacy Act of 1974'),
            ('permissible_use', 'Statistical release', 'CIPSEA Confidentiality'), ('permissible_use', 'Data inventory publication', 'OMB M-19-23 FDS Strategy'),
            ('permissible_use', 'Operational monitoring', 'FedRAMP High Baseline')) AS v(tbl, a, b)""")
def seed_governance(d):
    t = d.govs("governance_role", "policy", "security_marking", "permissible_use")
    t["policy"] = _text_ids(t["policy"], "policy_id")
    t["permissible_use"] = _text_ids(t["permissible_use"], "policy_id", "permissible_use_id")
    once = enrichment.seed_tables(d.spark, t)
    once["permissible_use"] = once["permissible_use"].join(once["policy"].select("policy_id", F.col("name").alias("policy_name")), "policy_id")
    columns = {
        "governance_role": ("governance_role_id", "name", "name"), "policy": ("policy_id", "name", "policy_type"),
        "security_marking": ("security_marking_id", "name", "classification_level"), "permissible_use": ("permissible_use_id", "use_case", "policy_name"),
    }
    return union_all([
        once[n].select(F.lit(n).alias("tbl"), F.col(a).alias("a"), F.col(b).alias("b"), (F.length(F.col(k)) == 64).alias("seeded"))
        for n, (k, a, b) in columns.items()
    ])


@query("""SELECT * FROM gov_dataset_policy UNION ALL
          SELECT DISTINCT d.dataset_id, p.policy_id FROM lineitem l JOIN gov_dataset d ON d.dataset_id = l.l_partkey
          JOIN gov_policy p ON p.policy_id = l.l_suppkey % 5 WHERE l.l_linenumber = 6 AND NOT EXISTS (
            SELECT 1 FROM gov_dataset_policy x WHERE x.dataset_id = d.dataset_id AND x.policy_id = p.policy_id)""")
def apply_policies(d):
    names = d.gov("policy").select(F.col("policy_id").alias("_p"), F.col("name").alias("policy_name"))
    wanted = d.table("lineitem").where("l_linenumber = 6").select(
        F.concat(F.lit("part-"), F.col("l_partkey").cast("string")).alias("source_identifier"),
        (F.col("l_suppkey") % 5).cast("int").alias("_p"),
    ).join(names, "_p").drop("_p")
    return enrichment.apply_policies(d.govs("dataset", "policy", "dataset_policy"), wanted)


@query("""SELECT count(*) AS rows_after, count(DISTINCT role_assignment_id) AS ids, count(*) FILTER (WHERE scope = 'seeded') AS added FROM (
            SELECT cast(role_assignment_id as varchar) AS role_assignment_id, scope FROM gov_role_assignment UNION ALL
            SELECT DISTINCT concat(r.governance_role_id, '/', cast(p.person_id as varchar), '/', cast(d.dataset_id as varchar)), 'seeded'
            FROM orders o JOIN gov_governance_role r ON r.name = upper(o.o_orderpriority)
            JOIN gov_person p ON lower(p.email) = concat('user', cast(o.o_custkey as varchar), '@x.gov')
            JOIN gov_dataset d ON d.dataset_id = o.o_custkey
            WHERE NOT EXISTS (SELECT 1 FROM gov_role_assignment e WHERE e.governance_role_id = r.governance_role_id
              AND e.person_id = p.person_id AND e.dataset_id = d.dataset_id))""")
def assign_roles(d):
    t = d.govs("role_assignment", "governance_role", "person", "dataset")
    t["role_assignment"] = _text_ids(t["role_assignment"], "role_assignment_id")
    wanted = d.table("orders").select(
        F.upper("o_orderpriority").alias("role_name"),
        F.concat(F.lit("USER"), F.col("o_custkey").cast("string"), F.lit("@x.gov")).alias("email"),
        F.concat(F.lit("part-"), F.col("o_custkey").cast("string")).alias("source_identifier"),
        F.lit("seeded").alias("scope"),
    ).distinct()
    return enrichment.assign_roles(t, wanted).agg(
        F.count("*").alias("rows_after"), F.countDistinct("role_assignment_id").alias("ids"),
        F.count_if(F.col("scope") == "seeded").alias("added"),
    )


def _files_wanted(d):
    """One file for every dataset, which many have already, and one more for some."""
    part = d.table("part")
    file = F.concat(F.lit("https://example.org/"), F.col("p_partkey").cast("string"))
    urls = F.array(F.concat(file, F.lit(".csv")), F.when(F.col("p_size") > 30, F.concat(file, F.lit(".json"))))
    return part.select(
        F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("source_identifier"),
        F.explode(urls).alias("download_url"), F.lit("added").alias("title"),
    ).where("download_url is not null")


@query("""SELECT dataset_id, download_url, title FROM gov_distribution UNION ALL
          SELECT d.dataset_id, w.url, 'added' FROM gov_dataset d JOIN (
            SELECT p_partkey, concat('https://example.org/', cast(p_partkey as varchar), '.csv') AS url FROM part UNION ALL
            SELECT p_partkey, concat('https://example.org/', cast(p_partkey as varchar), '.json') FROM part WHERE p_size > 30) w
            ON w.p_partkey = d.dataset_id
          WHERE NOT EXISTS (SELECT 1 FROM gov_distribution e WHERE e.dataset_id = d.dataset_id AND e.download_url = w.url)""")
def add_distributions(d):
    added = enrichment.add_distributions(d.govs("dataset", "distribution"), _files_wanted(d))
    return added.select("dataset_id", "download_url", "title")


@query("""SELECT * FROM gov_dataset_security_marking UNION ALL
          SELECT d.dataset_id, m.security_marking_id FROM gov_dataset d CROSS JOIN gov_security_marking m WHERE m.name = 'Public'
            AND NOT EXISTS (SELECT 1 FROM gov_dataset_security_marking e WHERE e.dataset_id = d.dataset_id
              AND e.security_marking_id = m.security_marking_id)""")
def assign_markings(d):
    wanted = d.gov("dataset").select("source_identifier", F.lit("Public").alias("marking_name"))
    return enrichment.assign_markings(d.govs("dataset", "security_marking", "dataset_security_marking"), wanted)


_ENRICHED = (
    "agency", "dataset", "distribution", "tag", "dataset_tag", "policy", "dataset_policy", "permissible_use",
    "permissible_use_condition", "person", "governance_role", "role_assignment", "security_marking", "dataset_security_marking",
)


@query("""WITH batch AS (SELECT p_partkey AS k, CASE WHEN p_size > 25 THEN concat('part-', cast(p_partkey as varchar))
                    ELSE concat('new-', cast(p_partkey as varchar)) END AS source FROM part),
          known AS (SELECT b.k, b.source FROM batch b)
          SELECT 'dataset' AS tbl, d.source_identifier AS a, CASE WHEN b.source IS NULL THEN d.title ELSE 'renewed' END AS b
            FROM gov_dataset d LEFT JOIN batch b ON b.source = d.source_identifier
          UNION ALL SELECT 'dataset', source, 'renewed' FROM known WHERE source LIKE 'new-%'
          UNION ALL SELECT 'distribution', concat('part-', cast(dataset_id as varchar)), download_url FROM gov_distribution
          UNION ALL SELECT 'distribution', source, 'added' FROM known
          UNION ALL SELECT 'dataset_tag', concat('part-', cast(dataset_id as varchar)), concat('tag', cast(tag_id as varchar)) FROM gov_dataset_tag
          UNION ALL SELECT 'dataset_tag', source, 'transit' FROM known
          UNION ALL SELECT 'dataset_policy', concat('part-', cast(dataset_id as varchar)), p.name FROM gov_dataset_policy x JOIN gov_policy p ON p.policy_id = x.policy_id
          UNION ALL SELECT 'dataset_policy', source, 'ASIA' FROM known WHERE source NOT IN (SELECT concat('part-', cast(dataset_id as varchar))
            FROM gov_dataset_policy x JOIN gov_policy p ON p.policy_id = x.policy_id WHERE p.name = 'ASIA')
          UNION ALL SELECT 'permissible_use_condition', source, 'regional count' FROM known
          UNION ALL SELECT 'role_assignment', source, 'ann@x.org' FROM known
          UNION ALL SELECT 'dataset_security_marking', concat('part-', cast(dataset_id as varchar)), m.name FROM gov_dataset_security_marking x
            JOIN gov_security_marking m ON m.security_marking_id = x.security_marking_id
          UNION ALL SELECT 'dataset_security_marking', source, 'CUI' FROM known WHERE source NOT IN (SELECT concat('part-', cast(dataset_id as varchar))
            FROM gov_dataset_security_marking x JOIN gov_security_marking m ON m.security_marking_id = x.security_marking_id WHERE m.name = 'CUI')
          UNION ALL SELECT 'agency', 'TRANSIT OFFICE', 'TO' UNION ALL SELECT 'tag', 'transit', 'keyword' UNION ALL SELECT 'person', 'Ann', 'ann@x.org'""")
def enrich_datasets(d):
    """A batch of annotated datasets, known ones and new ones, twice: the second run adds nothing."""
    t = d.govs(*_ENRICHED)
    for name, keys in {
        "agency": ["agency_id"], "dataset": ["dataset_id", "agency_id"], "distribution": ["dataset_id"], "tag": ["tag_id"],
        "dataset_tag": ["dataset_id", "tag_id"], "dataset_policy": ["dataset_id", "policy_id"], "policy": ["policy_id"],
        "permissible_use": ["policy_id", "permissible_use_id"], "person": ["person_id"],
        "permissible_use_condition": ["permissible_use_condition_id", "permissible_use_id", "dataset_id"],
        "role_assignment": ["role_assignment_id", "person_id", "dataset_id"], "dataset_security_marking": ["dataset_id"],
    }.items():
        t[name] = stage(_text_ids(t[name], *keys), name)
    t |= {name: stage(t[name], name) for name in ("governance_role", "security_marking")}
    part, key = d.table("part"), F.col("p_partkey").cast("string")
    source = F.when(F.col("p_size") > 25, F.concat(F.lit("part-"), key)).otherwise(F.concat(F.lit("new-"), key)).alias("source_identifier")

    def each(**columns):
        return part.select(source, *[F.lit(v).alias(c) for c, v in columns.items()])

    one = d.spark.range(1)
    rows = {
        "agency": one.select(*[F.lit(v).alias(c) for c, v in {
            "name": "TRANSIT OFFICE", "acronym": "TO", "description": "x", "contact_email": "to@x.org"}.items()]),
        "dataset": each(title="renewed", description="x", agency_name="Transit Office", landing_page="x", license="x", public_access_level="public"),
        "distribution": each(download_url="added", title="file"),
        "tag": one.select(F.lit("transit").alias("name"), F.lit("x").alias("description"), F.lit("keyword").alias("tag_type")),
        "dataset_tag": each(name="transit"),
        "dataset_policy": each(policy_name="ASIA"),
        "permissible_use_condition": each(
            policy_name="ASIA", use_case="NATION_7", condition_type="count", condition_value="regional count", condition_text="x", enforced_by="x"),
        "person": one.select(F.lit("Ann").alias("full_name"), F.lit("ann@x.org").alias("email"), F.lit("x").alias("organization")),
        "role_assignment": each(role_name="1-URGENT", email="ANN@x.org", scope="dataset"),
        "dataset_security_marking": each(marking_name="CUI"),
    }
    for run in ("2024-03-01", "2024-03-02"):
        t = enrichment.enrich_datasets(t, rows, run)
    of = t["dataset"].select("dataset_id", F.col("source_identifier").alias("a"))

    def links(name, **names):
        df = t[name].join(of, "dataset_id")
        for key, dim in names.items():
            df = df.join(t[dim].select(key, F.col("email" if dim == "person" else "name").alias("b")), key)
        return df.select(F.lit(name).alias("tbl"), "a", *(["b"] if names else []))

    new = t["permissible_use_condition"].where("condition_type = 'count'")
    return union_all([
        t["dataset"].select(F.lit("dataset").alias("tbl"), F.col("source_identifier").alias("a"), F.col("title").alias("b")),
        t["distribution"].join(of, "dataset_id").select(F.lit("distribution").alias("tbl"), "a", F.col("download_url").alias("b")),
        links("dataset_tag", tag_id="tag"), links("dataset_policy", policy_id="policy"),
        new.join(of, "dataset_id").select(F.lit("permissible_use_condition").alias("tbl"), "a", F.col("condition_value").alias("b")),
        t["role_assignment"].where("scope = 'dataset'").join(t["person"].where("email = 'ann@x.org'").select("person_id", "email"), "person_id")
        .join(of, "dataset_id").select(F.lit("role_assignment").alias("tbl"), "a", F.col("email").alias("b")),
        links("dataset_security_marking", security_marking_id="security_marking"),
        t["agency"].where("acronym = 'TO'").select(F.lit("agency").alias("tbl"), F.col("name").alias("a"), F.col("acronym").alias("b")),
        t["tag"].where("name = 'transit'").select(F.lit("tag").alias("tbl"), F.col("name").alias("a"), F.col("tag_type").alias("b")),
        t["person"].where("email = 'ann@x.org'").select(F.lit("person").alias("tbl"), F.col("full_name").alias("a"), F.col("email").alias("b")),
    ])


# --- functions -------------------------------------------------------------------------------

_COURT_FILE = """CASE WHEN c_custkey % 5 = 0 THEN concat(c_name, '.csv') WHEN c_custkey % 5 = 1 THEN NULL
    ELSE concat('Court Data_', cast(c_custkey as varchar(20)), '_', c_mktsegment, ' County Circuit Court.csv') END"""


@query(f"""SELECT c_custkey, CASE WHEN f IS NULL THEN NULL WHEN regexp_extract(f, '^.*_([A-Za-z ]+County[A-Za-z ]+Court)\\.csv$', 1) = ''
                  THEN 'Unknown Court' ELSE regexp_extract(f, '^.*_([A-Za-z ]+County[A-Za-z ]+Court)\\.csv$', 1) END AS court
           FROM (SELECT c_custkey, {_COURT_FILE} AS f FROM customer)""")
def court_from_file_name(d):
    return d.table("customer").select("c_custkey", court_from_filename(F.expr(_COURT_FILE)).alias("court"))


@query("SELECT doc_id, md5(text) AS content_hash FROM documents")
def md5_content(d):
    return d.table("documents").select("doc_id", content_hash(F.col("text")).alias("content_hash"))


@query("""SELECT user_id, event_type, CAST(date_diff('second', min(date_trunc('second', ts)), max(date_trunc('second', ts))) AS BIGINT) AS span_seconds
          FROM events GROUP BY user_id, event_type""")
def timestamp_difference(d):
    spans = d.table("events").groupBy("user_id", "event_type").agg(
        F.min(F.date_trunc("second", "ts")).alias("a"), F.max(F.date_trunc("second", "ts")).alias("b")
    )
    return spans.select("user_id", "event_type", seconds_between(F.col("a"), F.col("b")).alias("span_seconds"))


@query("""SELECT n, count(*) AS persons FROM (SELECT length(sha256(concat_ws(chr(1), concat('=', cast(person_id as varchar)),
              coalesce(concat('=', email), '~')))) AS n, sha256(concat_ws(chr(1), concat('=', cast(person_id as varchar)), coalesce(concat('=', email), '~'))) AS k
            FROM gov_person) GROUP BY n""")
def surrogate_keys(d):
    keyed = d.gov("person").select(surrogate_key(F.col("person_id"), F.col("email")).alias("k"))
    return keyed.distinct().groupBy(F.length("k").cast("bigint").alias("n")).agg(F.count("*").alias("persons"))


@query("""SELECT permissible_use_condition_id, CAST(json_object('dataset_id', dataset_id, 'condition_type', condition_type,
            'condition_value', condition_value) AS VARCHAR) AS document FROM gov_permissible_use_condition""")
def json_build_object(d):
    document = F.to_json(F.struct("dataset_id", "condition_type", "condition_value"), {"ignoreNullFields": "false"})
    return d.gov("permissible_use_condition").select("permissible_use_condition_id", document.alias("document"))


@query("""SELECT p_partkey, nullif(concat_ws('|', CASE WHEN p_size > 25 THEN p_name END, CASE WHEN p_size % 2 = 0 THEN p_brand END,
                 CASE WHEN p_size % 3 = 0 THEN p_type END), '') AS names FROM part""")
def array_without_nulls(d):
    kept = F.array_compact(F.array(
        F.when(F.col("p_size") > 25, F.col("p_name")), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")),
        F.when(F.col("p_size") % 3 == 0, F.col("p_type")),
    ))
    return d.table("part").select("p_partkey", F.when(F.size(kept) > 0, kept).alias("names"))


@query("""SELECT 'vw_catalog_dataset' AS view_name, count(*) AS row_count FROM gov_dataset
          UNION ALL SELECT 'vw_permissible_use', count(*) FROM gov_permissible_use
          UNION ALL SELECT 'vw_permissible_use_condition', count(*) FROM gov_permissible_use u
            LEFT JOIN gov_permissible_use_condition c ON c.permissible_use_id = u.permissible_use_id
          UNION ALL SELECT 'vw_governance_assignments', count(*) FROM gov_role_assignment
          UNION ALL SELECT 'vw_data_access_request', count(*) FROM gov_data_access_request""")
def sql_governance_views(d):
    names = (*_CATALOG, "permissible_use", "permissible_use_condition", "role_assignment", "governance_role", "person",
             "data_access_request", "decision_log")
    views = governance_views(d.govs(*names))
    register_views(views)
    return d.spark.sql(" UNION ALL ".join(f"SELECT '{v}' AS view_name, count(*) AS row_count FROM {v}" for v in views))


_SENSITIVE = "SELECT dataset_id FROM gov_dataset WHERE is_sensitive"


@query(f"""SELECT decision_log_id, CASE WHEN dataset_id NOT IN ({_SENSITIVE}) THEN dataset_id END AS dataset_id,
                  CASE WHEN related_request IN (SELECT request_id FROM gov_data_access_request WHERE dataset_id NOT IN ({_SENSITIVE}))
                       THEN related_request END AS related_request, decision_type FROM gov_decision_log""")
def delete_sets_null(d):
    """The decisions stay, their references to deleted datasets and requests go."""
    t = d.govs(*_DELETABLE)
    doomed = t["dataset"].where("is_sensitive").select("dataset_id")
    after = merge.delete_propagate(t, GOVERNANCE_FOREIGN_KEYS, "dataset", doomed)
    return after["decision_log"].select("decision_log_id", "dataset_id", "related_request", "decision_type")
