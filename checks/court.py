"""Case pipeline queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.fixtures import CASE_COLUMNS, CIVIL, ISO_DATE, KEPT_SYSTEM, LABEL, NA_EMPTY_REPLACED, NA_REPLACED, Data
from checks.registry import query, register
from recordloom.functions import label_subtype, nullif_na, safe_json, safe_to_date, to_bigint
from recordloom.functions.json import json_elements, unpack_fields
from recordloom.operators import aggregates, filters, joins, merge, quality
from recordloom.operators.audit import step_counts
from recordloom.plans import cases as plan
from recordloom.plans.loads import accept_cases, process_loads, unprocessed_loads
from recordloom.plans.sql_names import case_views, register_functions, register_views
from recordloom.schemas import CIVIL_SUBTYPES, CLEANED_COLUMNS, EXCLUDED_SYSTEMS

#: What may stand before a JSON document.
JSON_BLANKS = " \t\n\r"


def labelled(d: Data) -> DataFrame:
    return plan.label_with_lookup(d.src(), d.ct())


def routed(d: Data) -> DataFrame:
    return plan.route(labelled(d))


def finals(d: Data) -> tuple[DataFrame, DataFrame, DataFrame]:
    return plan.final_tables(d.src(), d.ct())


# --- projections, filters, predicates ---------------------------------------------------------

@query(f"SELECT DISTINCT {CASE_COLUMNS} FROM (SELECT *, court AS clear_type FROM src)")
def project_case(d):
    return plan.project_case(d.src().withColumn("category", F.col("court")))


@query(f"SELECT id, court_system, cjis, created_at, {', '.join(c for c in ('case_number', 'dob', 'status', 'location', 'defendant', 'plaintiff', 'versions', 'error'))} FROM (SELECT {NA_REPLACED} FROM src)")
def null_sentinels(d):
    return filters.null_sentinels(d.src(), CLEANED_COLUMNS).select(
        "id", "court_system", "cjis", "created_at", "case_number", "dob", "status", "location", "defendant",
        "plaintiff", "versions", "error",
    )


@query(f"SELECT id, cjis, filing_date, defendant, plaintiff, created_at FROM (SELECT {NA_EMPTY_REPLACED} FROM src)")
def null_sentinels_and_empty(d):
    return filters.null_sentinels(d.src(), CLEANED_COLUMNS, ("NA", "")).select(
        "id", "cjis", "filing_date", "defendant", "plaintiff", "created_at"
    )


@query(f"SELECT id, subtype FROM labelled WHERE subtype IN {CIVIL}")
def filter_in(d):
    return filters.filter_in(labelled(d), "subtype", CIVIL_SUBTYPES).select("id", "subtype")


@query(f"SELECT id, subtype FROM labelled WHERE subtype IS NULL OR subtype NOT IN {CIVIL}")
def filter_not_in_or_null(d):
    return filters.filter_not_in_or_null(labelled(d), "subtype", CIVIL_SUBTYPES).select("id", "subtype")


@query(f"SELECT id, court_system FROM src WHERE {KEPT_SYSTEM}")
def exclude_keywords(d):
    return filters.exclude_keywords(d.src(), "court_system", EXCLUDED_SYSTEMS).select("id", "court_system")


@query("SELECT id, case_type FROM src WHERE nullif(cjis, 'NA') IS NULL")
def filter_is_null(d):
    return filters.null_sentinels(d.src(), ["cjis"]).where(F.col("cjis").isNull()).select("id", "case_type")


@query("SELECT id, court_system FROM src WHERE court_system LIKE '%CIVIL%'")
def filter_contains(d):
    return d.src().where(F.col("court_system").contains("CIVIL")).select("id", "court_system")


@query("SELECT id, court_system FROM src WHERE court_system NOT LIKE '%CIVIL%' AND upper(court_system) LIKE '%CIVIL%'")
def filter_other_letter_case(d):
    system = F.col("court_system")
    return d.src().where(~system.contains("CIVIL") & F.upper(system).contains("CIVIL")).select("id", system)


def _label(mode: str, rest: str, where: str, name: str) -> None:
    def build(d: Data) -> DataFrame:
        rows = labelled(d)
        if mode == "A":
            rows = filters.filter_in(rows, "subtype", CIVIL_SUBTYPES)
        if mode == "B":
            rows = filters.filter_not_in_or_null(rows, "subtype", CIVIL_SUBTYPES)
        return rows.select("id", "subtype", label_subtype(F.col("subtype"), mode).alias("clear_type"))

    register(name, build, f"SELECT id, subtype, {LABEL.format(rest=rest)} AS clear_type FROM labelled {where}")


_label("A", "", f"WHERE subtype IN {CIVIL}", "label_civil_subtypes")
_label("B", "WHEN 'X' THEN 'OTHER CIVIL' ELSE 'NO INFORMATION'",
       f"WHERE subtype IS NULL OR subtype NOT IN {CIVIL}", "label_other_subtypes")
_label("V2", "WHEN 'X' THEN 'OTHER CIVIL' ELSE CASE WHEN subtype IS NULL THEN 'NO INFORMATION' ELSE 'UNKNOWN' END",
       "", "label_all_subtypes")


@query("SELECT s.id, s.load_id FROM src s JOIN gov_file_load f ON s.load_id = f.load_id WHERE f.load_status = 'completed'")
def filter_loads(d):
    completed = d.gov("file_load").where(F.col("load_status") == "completed")
    return filters.filter_loads(d.src(), completed).select("id", "load_id")


@query("SELECT id, defendant FROM src WHERE defendant IS NOT NULL AND defendant <> 'NA'")
def filter_usable_documents(d):
    return d.src().where(filters.usable_document(F.col("defendant"))).select("id", "defendant")


@query("""SELECT s.id, f.load_id, f.load_status FROM gov_file_load f JOIN src s ON s.load_id = f.load_id WHERE f.load_status = 'failed'""")
def filter_load_status(d):
    failed = d.gov("file_load").where(F.col("load_status") == "failed").select("load_id", "load_status")
    return d.src().join(failed, "load_id").select("id", "load_id", "load_status")


@query("SELECT doc_id, source FROM documents WHERE regexp_matches(source, '^src1') AND NOT regexp_matches(source, '[02468]$')")
def filter_names(d):
    return filters.filter_names(d.table("documents"), "source", ["^src1"], ["[02468]$"]).select("doc_id", "source")


# --- joins -----------------------------------------------------------------------------------

@query("SELECT s.id, s.case_type, c.subtype FROM src s LEFT JOIN ct c ON s.case_type = c.case_type")
def lookup_join(d):
    return labelled(d).select("id", "case_type", "subtype")


@query("SELECT s.id, s.case_type, c.subtype FROM src s LEFT JOIN ct c ON s.case_type = c.case_type")
def lookup_join_salted(d):
    """The same join as for a lookup that is too large to broadcast."""
    joined = joins.lookup_join(d.src().select("id", "case_type"), d.ct(), "case_type", broadcast_bytes=0, hot_rows=10, salts=8)
    return joined.select("id", "case_type", "subtype")


@query("""SELECT CAST(id AS BIGINT) AS row_id, load_id FROM src
          WHERE EXISTS (SELECT 1 FROM final_cases c WHERE c.row_id = CAST(src.id AS BIGINT))""")
def semi_join_accepted(d):
    keyed = d.src().select(to_bigint(F.col("id")).alias("row_id"), "load_id")
    return joins.keep_matching(keyed, finals(d)[0], "row_id")


@query("""SELECT CAST(id AS BIGINT) AS row_id, case_type FROM src
          WHERE NOT EXISTS (SELECT 1 FROM final_cases c WHERE c.row_id = CAST(src.id AS BIGINT))""")
def anti_join_rejected(d):
    keyed = d.src().select(to_bigint(F.col("id")).alias("row_id"), "case_type")
    return joins.drop_matching(keyed, finals(d)[0], "row_id")


@query("""SELECT c.row_id, c.case_number, c.caption, c.category, c.file_date, d.name AS defendant_name, d.city, d.state
          FROM final_cases c LEFT JOIN final_defendants d ON c.row_id = d.row_id""")
def case_party_report(d):
    cases, defendants, _ = finals(d)
    return plan.case_party_report(cases, defendants, "defendant")


@query("""SELECT id, nullif(CAST(e AS VARCHAR), 'null') AS element FROM (
            SELECT id, unnest(CASE WHEN json_type(j) = 'ARRAY' THEN from_json(j, '["JSON"]') ELSE [j] END) AS e
            FROM (SELECT id, CAST(plaintiff AS JSON) AS j FROM src
                  WHERE plaintiff IS NOT NULL AND plaintiff NOT IN ('NA', '') AND json_valid(plaintiff)))""")
def lateral_elements(d):
    """All documents; a JSON null is one element, NULL."""
    rows = d.src().where(filters.usable_document(F.col("plaintiff")))
    return rows.select("id", F.explode(json_elements(F.col("plaintiff"))).alias("element"))


# --- aggregations, sorting, set operations ---------------------------------------------------

@query("SELECT count(*) AS row_count FROM src")
def count_rows(d):
    return aggregates.row_count(d.src())


@query("""SELECT 'Cases' AS table_name, count(*) AS row_count, count(DISTINCT row_id) AS unique_keys FROM final_cases
          UNION ALL SELECT 'Defendants', count(*), count(DISTINCT row_id) FROM final_defendants
          UNION ALL SELECT 'Plaintiffs', count(*), count(DISTINCT row_id) FROM final_plaintiffs""")
def summary_per_table(d):
    return quality.union_all([
        aggregates.summary(df, "row_id", name) for name, df in zip(("Cases", "Defendants", "Plaintiffs"), finals(d))
    ])


@query("SELECT category, count(*) AS row_count FROM final_cases GROUP BY category")
def count_by_category(d):
    return aggregates.count_by(finals(d)[0], "category", skip_null=False)


@query("SELECT court, count(*) AS row_count FROM final_cases WHERE court IS NOT NULL GROUP BY court")
def count_by_court(d):
    return aggregates.count_by(finals(d)[0], "court")


@query("SELECT min(file_date) AS earliest, max(file_date) AS latest, count(*) AS row_count FROM final_cases")
def filing_date_range(d):
    return aggregates.date_range(finals(d)[0], "file_date")


@query(f"SELECT DISTINCT {CASE_COLUMNS} FROM branch_a")
def distinct_case_rows(d):
    return aggregates.distinct_rows(plan.project_case(plan.in_branch(routed(d), "A")))


@query("""SELECT f.load_id FROM gov_file_load f WHERE f.load_status = 'completed'
          AND f.load_id NOT IN (SELECT load_id FROM first_run_loads)""")
def collect_load_ids(d):
    """Load ids stay a frame: completed loads that have no case after a run over the started and the small ones."""
    source, ledger = d.amended(), d.gov("file_load")
    first = ledger.where("load_status = 'started' or (load_status = 'completed' and rows_loaded < 3)").select("load_id")
    none = accept_cases(source, d.ct()).where(F.lit(False))
    return unprocessed_loads(ledger, process_loads(source, d.ct(), none, first)[0])


@query("SELECT count(*) - count(DISTINCT row_id) AS duplicate_rows FROM final_cases")
def count_duplicates(d):
    return finals(d)[0].agg((F.count("*") - F.countDistinct("row_id")).alias("duplicate_rows"))


@query("SELECT category, count(*) AS row_count, (SELECT count(*) FROM final_cases) AS all_rows FROM final_cases GROUP BY category")
def scalar_subquery_total(d):
    cases = finals(d)[0]
    counts = cases.groupBy("category").agg(F.count("*").alias("row_count"))
    return counts.withColumn("all_rows", counts.agg(F.sum("row_count").alias("n")).scalar())


@query("""SELECT category, row_count, CAST((20000 * row_count + total) // (2 * total) AS DOUBLE) / 100 AS percentage FROM (
            SELECT category, count(*) AS row_count,
                   (SELECT count(*) FROM final_cases WHERE category IS NOT NULL) AS total
            FROM final_cases WHERE category IS NOT NULL GROUP BY category)""")
def share_by_category(d):
    return aggregates.share_by(finals(d)[0], "category")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem
          QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) = 1""")
def keep_first_per_key(d):
    lines = d.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return merge.pick_first(lines, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_quantity"])


@query("SELECT case_type, count(*) AS row_count FROM src WHERE case_type IS NOT NULL GROUP BY case_type")
def order_by_count(d):
    return aggregates.count_by(d.src(), "case_type")


@query("""SELECT court, count(*) AS row_count FROM final_cases WHERE court IS NOT NULL
          GROUP BY court ORDER BY row_count DESC, court LIMIT 10""")
def top_courts(d):
    return aggregates.count_by(finals(d)[0], "court", k=10)


@query("""SELECT row_id, case_number, substr(caption, 1, 50) AS caption, case_type, file_date, category FROM final_cases
          WHERE category IS NOT NULL ORDER BY row_id, category LIMIT 5""")
def preview_cases(d):
    cases = finals(d)[0].where(F.col("category").isNotNull())
    return cases.select(
        "row_id", "case_number", F.left("caption", F.lit(50)).alias("caption"), "case_type", "file_date", "category"
    ).orderBy("row_id", "category").limit(5)


@query("SELECT row_id, category, court_system FROM final_cases")
def union_branches(d):
    rows = routed(d)
    return quality.union_all([plan.build_cases(rows, b) for b in ("A", "B1", "B2")]).select(
        "row_id", "category", "court_system"
    )


@query("""SELECT 'Files Loaded' AS step, count(*) AS row_count FROM gov_file_load WHERE load_status = 'completed'
          UNION ALL SELECT 'Total Source Rows', count(*) FROM src
          UNION ALL SELECT 'Processed Cases', count(*) FROM final_cases
          UNION ALL SELECT 'Defendants', count(*) FROM final_defendants
          UNION ALL SELECT 'Plaintiffs', count(*) FROM final_plaintiffs""")
def union_report(d):
    cases, defendants, plaintiffs = finals(d)
    return step_counts({
        "Files Loaded": d.gov("file_load").where(F.col("load_status") == "completed"),
        "Total Source Rows": d.src(),
        "Processed Cases": cases,
        "Defendants": defendants,
        "Plaintiffs": plaintiffs,
    })


# --- scalar functions ------------------------------------------------------------------------

@query(f"SELECT id, filing_date, {ISO_DATE} AS file_date FROM src")
def safe_date(d):
    return d.src().select("id", "filing_date", safe_to_date(F.col("filing_date")).alias("file_date"))


@query("""SELECT id, CASE WHEN defendant NOT IN ('NA', '') AND json_valid(defendant) THEN defendant END AS document FROM src""")
def safe_json_text(d):
    return d.src().select("id", safe_json(F.col("defendant")).alias("document"))


@query("SELECT id, nullif(nullif(cjis, 'NA'), '') AS cjis, nullif(nullif(defendant, 'NA'), '') AS defendant FROM src")
def nullif_na_text(d):
    return d.src().select("id", nullif_na(F.col("cjis")).alias("cjis"), nullif_na(F.col("defendant")).alias("defendant"))


@query("SELECT CAST(id AS BIGINT) AS row_id, TRY_CAST(case_number AS BIGINT) AS case_no FROM src")
def cast_to_bigint(d):
    return d.src().select(
        to_bigint(F.col("id")).alias("row_id"), to_bigint(F.col("case_number"), "null").alias("case_no")
    )


@query("""SELECT id, upper(caption) AS up, lower(court_system) AS low, substr(caption, 1, 50) AS short,
                 court || '/' || CAST(load_id AS VARCHAR) AS joined, court LIKE '%County%' AS is_county FROM src""")
def text_functions(d):
    return d.src().select(
        "id", F.upper("caption").alias("up"), F.lower("court_system").alias("low"),
        F.left("caption", F.lit(50)).alias("short"),
        F.concat("court", F.lit("/"), F.col("load_id").cast("string")).alias("joined"),
        F.col("court").like("%County%").alias("is_county"),
    )


@query("""SELECT id, json_type(CAST(plaintiff AS JSON)) = 'ARRAY' AS is_array FROM src
          WHERE plaintiff NOT IN ('NA', '') AND json_valid(plaintiff)""")
def json_is_array(d):
    valid = d.src().where(safe_json(F.col("plaintiff")).isNotNull())
    return valid.select("id", F.ltrim("plaintiff", F.lit(JSON_BLANKS)).startswith("[").alias("is_array"))


@query("""SELECT id, CAST(json_array_length(CAST(defendant AS JSON)) AS BIGINT) AS n FROM src
          WHERE defendant NOT IN ('NA', '') AND json_valid(defendant) AND json_type(CAST(defendant AS JSON)) = 'ARRAY'""")
def json_array_elements(d):
    arrays = d.src().where(F.ltrim("defendant", F.lit(JSON_BLANKS)).startswith("[")).select("id", json_elements(F.col("defendant")).alias("e"))
    return arrays.where(F.col("e").isNotNull()).select("id", F.size("e").cast("bigint").alias("n"))


@query("""SELECT id, j->>'$."Party No."' AS party_num, j->>'$."Zip Code"' AS zip, j->>'$."Amount"' AS amount FROM (
            SELECT id, CAST(defendant AS JSON) AS j FROM src
            WHERE defendant NOT IN ('NA', '') AND json_valid(defendant) AND json_type(CAST(defendant AS JSON)) = 'OBJECT')""")
def json_fields(d):
    objects = d.src().where(F.ltrim("defendant", F.lit(JSON_BLANKS)).startswith("{") & safe_json(F.col("defendant")).isNotNull())
    record = unpack_fields(F.col("defendant"), {"party_num": "Party No.", "zip": "Zip Code", "amount": "Amount"})
    return objects.select("id", record.alias("r")).select(
        "id", F.col("r")["Party No."].alias("party_num"), F.col("r")["Zip Code"].alias("zip"), F.col("r")["Amount"].alias("amount")
    )


@query("""SELECT court, count(*) AS row_count, CAST((20000 * count(*) FILTER (WHERE cjis = 'C1') + count(*)) // (2 * count(*)) AS DOUBLE) / 100 AS percentage
          FROM src GROUP BY court""")
def rounded_percentage(d):
    counts = d.src().groupBy("court").agg(
        F.count("*").alias("row_count"), F.count_if(F.col("cjis") == "C1").alias("hits")
    )
    return counts.select("court", "row_count", aggregates.percentage(F.col("hits"), F.col("row_count")).alias("percentage"))


# --- pipelines -------------------------------------------------------------------------------

@query("SELECT * FROM cases_a")
def cases_branch_a(d):
    return plan.build_cases(routed(d), "A")


@query(f"SELECT id, subtype, clear_type AS category, court_system, cjis, versions FROM branch_b")
def clean_branch_b(d):
    rows = filters.filter_not_in_or_null(labelled(d), "subtype", CIVIL_SUBTYPES)
    return filters.null_sentinels(rows, CLEANED_COLUMNS).select(
        "id", "subtype", label_subtype(F.col("subtype"), "B").alias("category"), "court_system", "cjis", "versions"
    )


@query("SELECT * FROM cases_b1")
def cases_branch_b1(d):
    return plan.build_cases(routed(d), "B1")


@query("SELECT * FROM cases_b2")
def cases_branch_b2(d):
    return plan.build_cases(routed(d), "B2")


@query("SELECT * FROM final_cases")
def final_cases(d):
    return finals(d)[0]


@query("SELECT * FROM final_defendants")
def final_defendants(d):
    return finals(d)[1]


@query("SELECT * FROM final_plaintiffs")
def final_plaintiffs(d):
    return finals(d)[2]


# --- the same steps by their SQL names -------------------------------------------------------

@query(f"""SELECT id, {ISO_DATE} AS file_date, nullif(nullif(cjis, 'NA'), '') AS cjis, md5(caption) AS hash,
                  CASE WHEN plaintiff NOT IN ('NA', '') AND json_valid(plaintiff) THEN plaintiff END AS document,
                  CASE WHEN load_id % 2 = 0 THEN concat('A County Court ', CAST(load_id % 7 AS VARCHAR)) ELSE 'Unknown Court' END AS court
           FROM src""")
def sql_functions(d):
    register_functions(d.spark)
    d.src().createOrReplaceTempView("src_for_functions")
    return d.spark.sql("""
        SELECT id, safe_to_date(filing_date, 'YYYY-MM-DD') AS file_date, nullif_na(cjis) AS cjis,
               calculate_file_hash(caption) AS hash, safe_json(plaintiff) AS document,
               CASE WHEN load_id % 2 = 0
                    THEN concat(extract_court_from_filename(concat(id, '_A County Court.csv')), ' ', CAST(load_id % 7 AS STRING))
                    ELSE extract_court_from_filename(concat(id, '.csv')) END AS court
        FROM src_for_functions""")


_STEPS = {
    "vw_label_cases": "labelled", "vw_limit_by_subtype": "civil", "vw_real_nulls": "civil_nulls", "vw_drop_extras": "branch_a",
    "vw_save_off_the_non_civil": "non_civil", "vw_fix_the_nulls_here_too": "branch_b",
    "vw_catch_the_remaining_civil_cases": "branch_b1", "vw_remaining_civil_cases_2": "branch_b2",
    "vw_case_table": "cases_a", "vw_extra_case": "cases_b1", "vw_extra_case_2": "cases_b2", "vw_all_cases": "final_cases",
    "vw_all_defendants": "final_defendants", "vw_all_plaintiffs": "final_plaintiffs",
}


@query(" UNION ALL ".join(f"SELECT '{view}' AS step, count(*) AS row_count FROM {name}" for view, name in _STEPS.items()))
def sql_views(d):
    register_views(case_views(d.src(), d.ct()))
    return d.spark.sql(" UNION ALL ".join(f"SELECT '{v}' AS step, count(*) AS row_count FROM {v}" for v in _STEPS))


@query("""SELECT d.row_id, d.name, d.party_num, d.removal_date, p.name AS plaintiff_name FROM final_defendants d
          JOIN final_plaintiffs p ON p.row_id = d.row_id AND p.party_num = d.party_num""")
def sql_party_views(d):
    register_views(case_views(d.src(), d.ct()))
    return d.spark.sql("""
        SELECT d.row_id, d.name, d.party_num, d.removal_date, p.name AS plaintiff_name FROM vw_all_defendants d
        JOIN vw_all_plaintiffs p ON p.row_id = d.row_id AND p.party_num = d.party_num""")


@query("""SELECT row_id, nullif(CAST(e AS VARCHAR), 'null') AS element FROM (
            SELECT row_id, unnest(CASE WHEN json_type(j) = 'ARRAY' THEN from_json(j, '["JSON"]') ELSE [j] END) AS e
            FROM (SELECT CAST(id AS BIGINT) AS row_id, CAST(defendant AS JSON) AS j FROM branch_a
                  WHERE defendant IS NOT NULL AND defendant NOT IN ('NA', '') AND json_valid(defendant)))""")
def sql_array_views(d):
    """A JSON null among them is one element, NULL."""
    register_views(case_views(d.src(), d.ct()))
    return d.spark.sql("SELECT row_id, defendant AS element FROM vw_defendant_array")
