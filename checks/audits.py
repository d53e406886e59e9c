"""Data-quality, audit, profile, classification, lineage and usage queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.court import finals, labelled, routed
from checks.registry import query
from recordloom.operators import audit, bitmaps, filters, quality, sampling
from recordloom.plans import cases as plan
from recordloom.plans import classify, heavy_hitters, lineage, profile, profile_state, reachability, usage
from recordloom.schemas import CASE_FILE_COLUMNS, CIVIL_SUBTYPES, LOAD_STATUSES
from recordloom.session import scratch_path, stage
from recordloom.sources import tables

# --- quality ---------------------------------------------------------------------------------


def _count_row(name: str, table: str, limit: int) -> str:
    return (
        f"SELECT '{name}' AS check_name, count(*) AS value, CASE WHEN count(*) > {limit} THEN 'OK' "
        f"WHEN count(*) > 0 THEN 'WARN' ELSE 'FAIL' END AS status FROM {table}"
    )


@query(" UNION ALL ".join([
    _count_row("source_data", "src", 25000), _count_row("case_types", "part", 300), _count_row("final_cases", "final_cases", 0),
    _count_row("final_defendants", "final_defendants", 0), _count_row("final_plaintiffs", "final_plaintiffs", 0),
    "SELECT 'missing_table', 0, 'FAIL'",
]))
def row_count_checks(d):
    cases, defendants, plaintiffs = finals(d)
    return quality.row_count_report(
        {"source_data": d.src(), "case_types": d.table("part"), "final_cases": cases, "final_defendants": defendants,
         "final_plaintiffs": plaintiffs, "missing_table": None},
        {"source_data": quality.SOURCE_ROWS, "case_types": quality.LOOKUP_ROWS},
    )


@query("""SELECT 'Cases with NULL row_id' AS check_name, count(*) FILTER (WHERE row_id IS NULL) AS value,
                 CASE WHEN count(*) FILTER (WHERE row_id IS NULL) = 0 THEN 'OK' ELSE 'FAIL' END AS status FROM final_cases
          UNION ALL SELECT 'Cases with NULL file_date', count(*) FILTER (WHERE file_date IS NULL),
                 CASE WHEN count(*) FILTER (WHERE file_date IS NULL) < count(*) * 0.5 THEN 'OK' ELSE 'WARN' END FROM final_cases
          UNION ALL SELECT 'Cases with NULL category', count(*) FILTER (WHERE category IS NULL),
                 CASE WHEN count(*) FILTER (WHERE category IS NULL) < count(*) * 0.5 THEN 'OK' ELSE 'WARN' END FROM final_cases
          UNION ALL SELECT 'Defendants with NULL row_id', count(*) FILTER (WHERE row_id IS NULL),
                 CASE WHEN count(*) FILTER (WHERE row_id IS NULL) = 0 THEN 'OK' ELSE 'FAIL' END FROM final_defendants
          UNION ALL SELECT 'Plaintiffs with NULL row_id', count(*) FILTER (WHERE row_id IS NULL),
                 CASE WHEN count(*) FILTER (WHERE row_id IS NULL) = 0 THEN 'OK' ELSE 'FAIL' END FROM final_plaintiffs""")
def null_checks(d):
    cases, defendants, plaintiffs = finals(d)
    return quality.union_all([
        quality.null_check(cases, ["row_id", "file_date", "category"], "Cases", {"file_date": 0.5, "category": 0.5}),
        quality.null_check(defendants, ["row_id"], "Defendants"),
        quality.null_check(plaintiffs, ["row_id"], "Plaintiffs"),
    ])


@query("""WITH total AS (SELECT count(*) AS n FROM final_cases)
          SELECT metric, row_count, CAST((20000 * row_count + n) // (2 * n) AS DOUBLE) / 100 AS percentage FROM total, (
            SELECT 'Cases with defendants' AS metric, count(DISTINCT c.row_id) AS row_count FROM final_cases c JOIN final_defendants d ON c.row_id = d.row_id
            UNION ALL SELECT 'Cases with plaintiffs', count(DISTINCT c.row_id) FROM final_cases c JOIN final_plaintiffs p ON c.row_id = p.row_id
            UNION ALL SELECT 'Cases with both', count(DISTINCT c.row_id) FROM final_cases c JOIN final_defendants d ON c.row_id = d.row_id
              JOIN final_plaintiffs p ON c.row_id = p.row_id)""")
def linkage_coverage(d):
    return quality.linkage_report(*finals(d))


@query("""WITH total AS (SELECT count(*) AS n FROM final_cases)
          SELECT metric, row_count, CAST((20000 * row_count + n) // (2 * n) AS DOUBLE) / 100 AS percentage FROM total, (
            SELECT 'Cases with defendants' AS metric, count(DISTINCT row_id) AS row_count FROM final_cases WHERE row_id IN (SELECT row_id FROM final_defendants)
            UNION ALL SELECT 'Cases with plaintiffs', count(DISTINCT row_id) FROM final_cases WHERE row_id IN (SELECT row_id FROM final_plaintiffs)
            UNION ALL SELECT 'Cases with both', count(DISTINCT row_id) FROM final_cases
              WHERE row_id IN (SELECT row_id FROM final_plaintiffs) AND row_id IN (SELECT row_id FROM final_defendants))""")
def linkage_by_bitmaps(d):
    names = ("cases", "defendants", "plaintiffs")
    return bitmaps.linkage(quality.union_all([bitmaps.key_states(df, "row_id", name) for name, df in zip(names, finals(d))]))


@query("""SELECT 'amended' AS table_name, count(*) AS row_count, count(DISTINCT CAST(id AS BIGINT)) AS unique_keys FROM amended_src
          UNION ALL SELECT 'customers', count(*), count(DISTINCT o_custkey) FROM orders""")
def distinct_by_load(d):
    """States of loads, written in three runs, of which the last comes again."""
    path, rows = scratch_path(d.spark, "key-states"), d.amended()
    for part in ("load_id % 2 = 0", "load_id % 2 = 1", "load_id = 3"):
        bitmaps.write_states(bitmaps.key_states(rows.where(part), "id", "amended", "load_id"), path)
    bitmaps.write_states(bitmaps.key_states(d.table("orders"), "o_custkey", "customers", F.col("o_orderkey") % 5), path)
    return bitmaps.summary(bitmaps.read_states(d.spark, path))


@query("""SELECT 'Duplicate row_id' AS check_name, count(*) - count(DISTINCT row_id) AS value,
                 CASE WHEN count(*) = count(DISTINCT row_id) THEN 'OK' ELSE 'WARN' END AS status FROM final_cases""")
def duplicate_key_check(d):
    return quality.duplicate_check(finals(d)[0], "row_id")


@query("SELECT row_id, count(*) AS row_count FROM final_cases GROUP BY row_id HAVING count(*) > 1")
def duplicate_keys(d):
    return quality.unique_violations(finals(d)[0], {"row_id": F.col("row_id")})


@query("SELECT lower(email) AS email, count(*) AS row_count FROM gov_person WHERE email IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def unique_lower_email(d):
    return quality.unique_violations(d.gov("person"), {"email": F.lower("email")}, F.col("email").isNotNull())


@query("""SELECT status AS case_status, court_id, count(*) AS row_count FROM src WHERE status IS NOT NULL AND court_id IS NOT NULL
          GROUP BY 1, 2 HAVING count(*) > 1""")
def unique_composite_key(d):
    return quality.unique_violations(d.src(), {"case_status": F.col("status"), "court_id": F.col("court_id")})


@query("""SELECT agency_id, count(*) AS row_count FROM gov_dataset WHERE agency_id IS NOT NULL
          AND agency_id NOT IN (SELECT agency_id FROM gov_agency) GROUP BY agency_id""")
def orphan_agencies(d):
    return quality.orphans(d.gov("dataset"), "agency_id", d.gov("agency"), "agency_id")


@query("""SELECT dataset_id, count(*) AS row_count FROM gov_role_assignment a WHERE dataset_id IS NOT NULL
          AND NOT EXISTS (SELECT 1 FROM gov_dataset x WHERE x.dataset_id = a.dataset_id AND x.is_sensitive) GROUP BY dataset_id""")
def orphan_role_datasets(d):
    return quality.orphans(d.gov("role_assignment"), "dataset_id", d.gov("dataset").where("is_sensitive"), "dataset_id")


@query("SELECT request_id, status FROM gov_data_access_request WHERE status NOT IN ('pending', 'approved', 'denied')")
def domain_violations(d):
    return quality.domain_violations(d.gov("data_access_request"), "status", ["pending", "approved", "denied"]).select(
        "request_id", "status"
    )


@query("""SELECT s.id, f.load_status FROM src s JOIN gov_file_load f ON f.load_id = s.load_id
          WHERE f.load_status IN ('started', 'completed', 'failed') AND s.status <> 'P'""")
def allowed_load_status(d):
    """Rows that are left when those with a status outside the list, here every pending one, are found and dropped."""
    rows = d.src().select("id", "load_id", "status").join(d.gov("file_load").select("load_id", "load_status"), "load_id")
    rows = rows.withColumn("load_status", F.when(F.col("status") == "P", "pending").otherwise(F.col("load_status")))
    rows = rows.withColumn("load_status", F.when(F.col("status").isNull(), None).otherwise(F.col("load_status")))
    bad = quality.domain_violations(rows, "load_status", LOAD_STATUSES).select("id")
    return rows.join(bad, "id", "left_anti").where("status is not null").select("id", "load_status")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus NOT IN ('O', 'F')")
def order_status_violations(d):
    return quality.domain_violations(d.table("orders"), "o_orderstatus", ["O", "F"]).select("o_orderkey", "o_orderstatus")


@query("""SELECT * FROM (SELECT 'email' AS column_name, count(*) FILTER (WHERE email IS NULL) AS null_rows FROM gov_person
          UNION ALL SELECT 'full_name', count(*) FILTER (WHERE full_name IS NULL) FROM gov_person
          UNION ALL SELECT 'person_id', count(*) FILTER (WHERE person_id IS NULL) FROM gov_person) WHERE null_rows > 0""")
def not_null_violations(d):
    return quality.not_null_violations(d.gov("person"), ["person_id", "full_name", "email"])


@query("""SELECT 'source_data' AS step, count(*) AS row_count FROM src UNION ALL SELECT 'labelled', count(*) FROM labelled
          UNION ALL SELECT 'civil', count(*) FROM civil UNION ALL SELECT 'accepted', count(*) FROM branch_a
          UNION ALL SELECT 'final_cases', count(*) FROM final_cases""")
def step_counts(d):
    rows = routed(d)
    return audit.step_counts({
        "source_data": d.src(),
        "labelled": labelled(d),
        "civil": filters.filter_in(labelled(d), "subtype", CIVIL_SUBTYPES),
        "accepted": plan.in_branch(rows, "A"),
        "final_cases": plan.build_cases(rows),
    })


@query("""SELECT 'source_data' AS step, count(*) AS row_count FROM src UNION ALL SELECT 'labelled', count(*) FROM labelled
          UNION ALL SELECT 'civil', count(*) FROM civil UNION ALL SELECT 'accepted', count(*) FROM branch_a
          UNION ALL SELECT 'final_cases', count(*) FROM final_cases UNION ALL SELECT 'final_defendants', count(*) FROM final_defendants
          UNION ALL SELECT 'final_plaintiffs', count(*) FROM final_plaintiffs""")
def published_step_counts(d):
    """Counted while the tables are published."""
    counter = audit.StepCounter()
    plan.publish(d.src(), d.ct(), scratch_path(d.spark, "published"), counter)
    return counter.counts(d.spark)


@query("""SELECT f.load_id, f.file_name, f.load_status, f.error_message, f.rows_loaded,
                 CAST(date_diff('second', f.load_started_at, f.load_completed_at) AS BIGINT) AS duration_seconds,
                 coalesce(s.n, 0) AS source_rows, coalesce(s.m, 0) AS processed_rows
          FROM gov_file_load f LEFT JOIN (
            SELECT load_id, count(*) AS n, count(*) FILTER (WHERE source_id IN (SELECT row_id FROM final_cases)) AS m
            FROM src GROUP BY load_id) s ON s.load_id = f.load_id""")
def load_ledger_report(d):
    cases = finals(d)[0].select(F.col("row_id").alias("source_id"))
    return audit.load_report(d.gov("file_load"), d.src(), cases)


# --- profile, classification, lineage, usage -------------------------------------------------


def _sum_sql(column: str) -> str:
    """Whole numbers to the last digit, others to one decimal."""
    return (
        f"CASE WHEN typeof(any_value({column})) = 'DOUBLE' THEN CAST(CAST(round(CAST(sum({column}) AS DOUBLE), 1) AS DECIMAL(38,1)) AS VARCHAR) "
        f"ELSE CAST(CAST(sum({column}) AS DECIMAL(38,0)) AS VARCHAR) END"
    )


def _profile_sql(table: str, numbers: list[str], texts: list[str], others: list[str]) -> str:
    rows = []
    for c in numbers + texts + others:
        n, t = c in numbers, c in texts
        rows.append(
            f"SELECT '{c}' AS column_name, count(*) AS row_count, count(*) - count({c}) AS null_count, "
            f"CAST(min({c}) AS VARCHAR) AS min_value, CAST(max({c}) AS VARCHAR) AS max_value, "
            f"{f'round(avg({c}), 4)' if n else 'CAST(NULL AS DOUBLE)'} AS mean, "
            f"{f'round(stddev_samp({c}), 4)' if n else 'CAST(NULL AS DOUBLE)'} AS stddev, "
            f"{_sum_sql(c) if n else 'CAST(NULL AS VARCHAR)'} AS sum, "
            f"{f'min(length({c}))' if t else 'CAST(NULL AS BIGINT)'} AS min_length, "
            f"{f'max(length({c}))' if t else 'CAST(NULL AS BIGINT)'} AS max_length, "
            f"{f'round(avg(length({c})), 4)' if t else 'CAST(NULL AS DOUBLE)'} AS avg_length, "
            f"count(DISTINCT {c}) AS distinct_count, "
            f"CAST((20000 * (count(*) - count({c})) + count(*)) // (2 * count(*)) AS DOUBLE) / 100 AS null_percent FROM {table}"
        )
    return " UNION ALL ".join(rows)


def _rounded(df):
    return df.withColumns({
        "mean": F.round("mean", 4), "stddev": F.round("stddev", 4),
        "sum": F.when(F.col("sum").contains("."), F.round(F.col("sum").cast("double"), 1).cast("decimal(38,1)").cast("string")).otherwise(F.col("sum")),
        "avg_length": F.round("avg_length", 4),
    })


@query(_profile_sql("orders", ["o_orderkey", "o_custkey", "o_totalprice"], ["o_orderstatus", "o_orderpriority"], ["o_orderdate"]))
def profile_orders(d):
    return _rounded(profile.profile(d.table("orders"), approx_distinct=False))


@query(f"""SELECT * EXCLUDE (distinct_count), true AS distinct_within FROM ({_profile_sql("src", ["source_id"], CASE_FILE_COLUMNS, [])})""")
def profile_by_load(d):
    """Loads are profiled in three runs; their states alone make the profile of all."""
    path, landed = scratch_path(d.spark, "states"), scratch_path(d.spark, "landing")
    rows = tables.materialize(d.src().select("source_id", *CASE_FILE_COLUMNS, "load_id"), landed, ["load_id"])
    loads = rows.select("load_id").distinct()
    for part in ("load_id % 2 = 0", "load_id % 2 = 1", "load_id = 3"):
        profile_state.profile_loads(rows, loads.where(part), path)
    stats = _rounded(profile_state.merged_profile(profile_state.read_states(d.spark, path)))
    exact = profile.distinct_counts(rows, ["source_id", *CASE_FILE_COLUMNS]).withColumnRenamed("distinct_count", "exact")
    off = F.abs(F.col("distinct_count") - F.coalesce("exact", F.lit(0)))
    within = (off <= profile_state.DISTINCT_ERROR * F.coalesce("exact", F.lit(0))).alias("distinct_within")
    return stats.join(exact, "column_name", "left").select(*[c for c in stats.columns if c != "distinct_count"], within)


@query("""SELECT c.name AS column_name, p.p AS probability, true AS rank_within FROM (VALUES ('o_totalprice'), ('o_custkey'), ('o_orderkey')) c(name),
          (VALUES (0.0::DOUBLE), (0.01::DOUBLE), (0.25::DOUBLE), (0.5::DOUBLE), (0.99::DOUBLE), (1.0::DOUBLE)) p(p)""")
def quantiles_by_load(d):
    """Quantiles of merged sketches, held against the ranks they have in all rows."""
    path, landed = scratch_path(d.spark, "states"), scratch_path(d.spark, "landing")
    columns = ["o_totalprice", "o_custkey", "o_orderkey"]
    rows = d.table("orders").select(*columns, (F.col("o_orderkey") % 9).cast("int").alias("load_id"))
    rows = tables.materialize(rows, landed, ["load_id"])
    profile_state.profile_loads(rows, rows.select("load_id").distinct(), path)
    found = profile_state.merged_quantiles(profile_state.read_states(d.spark, path), [0.0, 0.01, 0.25, 0.5, 0.99, 1.0])
    cells = rows.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("cell")) for c in columns])))
    ranks = cells.join(F.broadcast(found), "column_name").groupBy("column_name", "probability").agg(
        (F.count_if(F.col("cell") < F.col("value")) / F.count("*")).alias("below"), (F.count_if(F.col("cell") <= F.col("value")) / F.count("*")).alias("upto")
    )
    error = profile_state.RANK_ERROR
    return ranks.select("column_name", "probability", ((F.col("below") - error <= F.col("probability")) & (F.col("probability") <= F.col("upto") + error)).alias("rank_within"))


@query(_profile_sql("src", ["source_id", "load_id"], CASE_FILE_COLUMNS, []))
def profile_source_text(d):
    return _rounded(profile.profile(d.src(), approx_distinct=False))


_SAMPLED = "(SELECT * FROM orders WHERE CAST(concat('0x', substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 7)) AS BIGINT) % 100 < 80)"


@query(_profile_sql(_SAMPLED, ["o_orderkey", "o_custkey", "o_totalprice"], ["o_orderstatus", "o_orderpriority"], ["o_orderdate"]))
def profile_sample(d):
    return _rounded(profile.profile(d.table("orders"), "o_orderkey", sampling.SAMPLE_PERCENT["published"], approx_distinct=False))


_QUANTILES = [0.25, 0.5, 0.75, 0.99]


@query(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST({p} AS DOUBLE) AS probability, CAST(quantile_disc({c}, {p}) AS VARCHAR) AS value FROM orders"
    for c in ("o_totalprice", "o_custkey") for p in _QUANTILES
))
def quantiles_orders(d):
    """Few values per range, so that ranks fall into several of them."""
    return quality.union_all([
        profile.quantiles(d.table("orders"), c, _QUANTILES, slice_values=1000).withColumn("value", F.col("value").cast("string"))
        for c in ("o_totalprice", "o_custkey")
    ])


@query(_profile_sql("documents", ["doc_id", "n_chars"], ["text", "lang", "source"], []).replace(
    "CAST(min(text) AS VARCHAR)", "md5(min(text))").replace("CAST(max(text) AS VARCHAR)", "md5(max(text))"))
def profile_documents(d):
    stats = _rounded(profile.profile(d.table("documents"), approx_distinct=False))
    is_text = F.col("column_name") == "text"
    return stats.withColumns({
        c: F.when(is_text, F.md5(c)).otherwise(F.col(c)) for c in ("min_value", "max_value")
    })


def _share(table: str, key: str, percent: int) -> str:
    return f"(SELECT * FROM {table} WHERE CAST(concat('0x', substr(md5(CAST({key} AS VARCHAR)), 1, 7)) AS BIGINT) % 100 < {percent})"


@query(f"""SELECT 'supplier' AS table_name, * FROM ({_profile_sql("supplier", ["s_suppkey", "s_nationkey", "s_acctbal"], ["s_name"], [])})
           UNION ALL SELECT 'customer', * FROM ({_profile_sql(_share("customer", "c_custkey", 80), ["c_custkey", "c_nationkey", "c_acctbal"], ["c_name", "c_mktsegment"], [])})
           UNION ALL SELECT 'orders', * FROM ({_profile_sql(_share("orders", "o_orderkey", 50), ["o_orderkey", "o_custkey", "o_totalprice"],
                                                            ["o_orderstatus", "o_orderpriority"], ["o_orderdate"])})""")
def profile_tables(d):
    tables = {n: d.table(n) for n in ("supplier", "customer", "orders")}
    keys = {"supplier": "s_suppkey", "customer": "c_custkey", "orders": "o_orderkey"}
    percent = {
        "supplier": sampling.SAMPLE_PERCENT["governance"], "customer": sampling.SAMPLE_PERCENT["published"],
        "orders": sampling.SAMPLE_PERCENT["source"],
    }
    return _rounded(profile.profile_all(tables, percent, keys, approx_distinct=False))


@query("SELECT * REPLACE (CAST(o_orderdate AS VARCHAR) AS o_orderdate) FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 50)")
def sample_rows(d):
    return sampling.sample_rows(d.table("orders"), "o_orderkey")


_DOC_RULES = [r for r in classify.RULES if r.value_pattern]


def _ratio(column: str, rule) -> str:
    pattern = rule.value_pattern
    return (
        f"SELECT '{column}' AS column_name, '{rule.tag}' AS tag, 'value' AS matched_by, "
        f"round(CAST(count(*) FILTER (WHERE regexp_matches({column}, '{pattern}')) AS DOUBLE) / count({column}), 6) AS match_ratio FROM documents"
    )


@query("SELECT * FROM (" + " UNION ALL ".join(_ratio(c, r) for c in ("text", "lang", "source") for r in _DOC_RULES) + ") WHERE match_ratio >= 0.01")
def classify_document_columns(d):
    return classify.classify_columns(d.table("documents"), _DOC_RULES, min_ratio=0.01)


@query("""SELECT 'full_name' AS column_name, 'PersonName' AS tag, 'name' AS matched_by, 0.0::DOUBLE AS match_ratio UNION ALL
          SELECT 'email', 'Email', CASE WHEN r >= 0.5 THEN 'value' ELSE 'name' END, r FROM (
            SELECT round(CAST(count(*) FILTER (WHERE regexp_matches(email, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')) AS DOUBLE) / count(email), 6) AS r
            FROM gov_person WHERE CAST(concat('0x', substr(md5(CAST(person_id AS VARCHAR)), 1, 7)) AS BIGINT) % 100 < 80)""")
def classify_person_columns(d):
    return classify.classify_columns(d.gov("person"), key="person_id", sample_pct=80)


_LUHN = """list_sum(list_transform(range(1, 17), lambda i: CASE WHEN i % 2 = 0 THEN ascii(substr(x, i, 1)) - 48
    ELSE (2 * (ascii(substr(x, i, 1)) - 48)) % 10 + (2 * (ascii(substr(x, i, 1)) - 48)) // 10 END)) % 10 = 0"""
_MOD_97 = """list_reduce(list_prepend(0, list_transform(range(1, length(x) + 1), lambda i: ascii(substr(substr(x, 5) || substr(x, 1, 4), i, 1)))),
    lambda a, c: CASE WHEN c < 58 THEN (a * 10 + c - 48) % 97 ELSE (a * 100 + c - 55) % 97 END) = 1"""


def _checked(column: str, table: str) -> str:
    email, card, account = (r.value_pattern for r in classify.CHECKED_RULES)
    hits = {
        "Email": f"regexp_matches({column}, '{email}')",
        "CreditCard": f"len(list_filter(list_transform(regexp_extract_all({column}, '{card}'), lambda y: regexp_replace(y, '[ -]', '', 'g')), lambda x: {_LUHN})) > 0",
        "BankAccount": f"len(list_filter(regexp_extract_all({column}, '{account}'), lambda x: {_MOD_97})) > 0",
    }
    return " UNION ALL ".join(
        f"SELECT '{column}' AS column_name, '{tag}' AS tag, 'value' AS matched_by, "
        f"round(CAST(count(*) FILTER (WHERE {hit}) AS DOUBLE) / count({column}), 6) AS match_ratio FROM {table}" for tag, hit in hits.items()
    )


@query("""WITH numbers AS (SELECT printf('4000 %04d %04d-%04d', c_custkey % 10000, c_custkey * 7 % 10000, c_custkey * 13 % 10000) AS card,
            printf('DE%02d%018d', c_custkey % 97 + 2, c_custkey) AS account, c_name || '@example.org' AS mail FROM customer)
          """ + " UNION ALL ".join(_checked(c, t) for c, t in (("card", "numbers"), ("account", "numbers"), ("mail", "numbers"), ("text", "documents"))))
def classify_checked_numbers(d):
    """Shares of values with right check digits, in generated numbers of which most are wrong and in documents."""
    key = F.col("c_custkey").cast("long")
    numbers = d.table("customer").select(
        F.format_string("4000 %04d %04d-%04d", key % 10000, key * 7 % 10000, key * 13 % 10000).alias("card"),
        F.format_string("DE%02d%018d", key % 97 + 2, key).alias("account"), F.concat("c_name", F.lit("@example.org")).alias("mail"),
    )
    found = [classify.classify_columns(t, classify.CHECKED_RULES, min_ratio=0.0) for t in (numbers, d.table("documents").select("text"))]
    return found[0].unionByName(found[1])


@query("""SELECT l.upstream_dataset_id, u.title AS upstream_title, l.downstream_dataset_id, w.title AS downstream_title, l.lineage_type
          FROM gov_dataset_lineage l LEFT JOIN gov_dataset u ON u.dataset_id = l.upstream_dataset_id
          LEFT JOIN gov_dataset w ON w.dataset_id = l.downstream_dataset_id""")
def lineage_edges(d):
    return lineage.lineage_edges(d.gov("dataset_lineage"), d.gov("dataset"))


def _closure_sql(source: str, target: str, starts: str) -> str:
    return f"""WITH reach AS (
        SELECT s.id AS start_id, l.{target}_dataset_id AS dataset_id, 1 AS depth FROM ({starts}) s
        JOIN gov_dataset_lineage l ON l.{source}_dataset_id = s.id
        UNION ALL
        SELECT r.start_id, l.{target}_dataset_id, r.depth + 1 FROM reach r JOIN gov_dataset_lineage l ON l.{source}_dataset_id = r.dataset_id)
      SELECT start_id, dataset_id, min(depth) AS depth FROM reach GROUP BY start_id, dataset_id"""


@query(_closure_sql("upstream", "downstream", """SELECT DISTINCT upstream_dataset_id AS id FROM gov_dataset_lineage
    WHERE upstream_dataset_id NOT IN (SELECT downstream_dataset_id FROM gov_dataset_lineage)"""))
def lineage_downstream(d):
    edges = d.gov("dataset_lineage")
    return lineage.lineage_closure(edges, lineage.endpoints(edges))


@query(_closure_sql("downstream", "upstream", "SELECT dataset_id AS id FROM gov_dataset WHERE is_sensitive AND public_access_level = 'public'"))
def lineage_upstream(d):
    """Where the data of public datasets with sensitive content comes from."""
    starts = d.gov("dataset").where("is_sensitive and public_access_level = 'public'").select("dataset_id")
    return lineage.lineage_closure(d.gov("dataset_lineage"), starts, "upstream")


@query("""SELECT * FROM (WITH RECURSIVE e AS (
            SELECT upstream_dataset_id AS a, downstream_dataset_id AS b FROM gov_dataset_lineage
            UNION SELECT downstream_dataset_id, CAST(floor(downstream_dataset_id / 4) AS BIGINT) FROM gov_dataset_lineage WHERE downstream_dataset_id % 97 < 2),
          reach(start_id, dataset_id) AS (SELECT a, b FROM e UNION SELECT r.start_id, e.b FROM reach r JOIN e ON e.a = r.dataset_id)
          SELECT start_id, dataset_id FROM reach WHERE start_id <> dataset_id)""")
def lineage_reachable(d):
    """From every dataset, in a graph whose edges back to the grandparent make cycles."""
    edges = d.gov("dataset_lineage").select("upstream_dataset_id", "downstream_dataset_id")
    back = edges.where("downstream_dataset_id % 97 < 2").select(
        F.col("downstream_dataset_id").alias("upstream_dataset_id"), F.floor(F.col("downstream_dataset_id") / 4).cast("bigint").alias("downstream_dataset_id")
    )
    edges = edges.unionByName(back)
    starts = edges.select(F.col("upstream_dataset_id").alias("dataset_id")).union(edges.select("downstream_dataset_id"))
    return reachability.reachable(edges, starts)


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, user_id, event_type, count(*) AS uses FROM events GROUP BY ALL")
def usage_per_day(d):
    return usage.usage_rollup(d.table("events"), ["user_id", "event_type"])


@query("""SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, user_id, event_type, count(*) AS uses FROM events
          WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-15' GROUP BY ALL
          ORDER BY uses DESC, day, user_id, event_type LIMIT 1000""")
def usage_top_report(d):
    recent = usage.recent_log(d.table("events"), "2024-01-15 00:00:00")
    return usage.usage_rollup(recent, ["user_id", "event_type"], top_n=usage.RESULT_LIMIT)


@query("""WITH log AS (SELECT CAST(ts AS DATE) AS day, user_id % (1 + user_id % 50) AS team FROM events),
          counts AS (SELECT e.day AS last_day, team, count(*) AS uses FROM (SELECT DISTINCT day FROM log) e
            JOIN log l ON l.day <= e.day AND l.day > e.day - INTERVAL 7 DAY GROUP BY ALL)
          SELECT CAST(last_day AS VARCHAR) AS last_day, team, uses, true AS certain FROM counts
          QUALIFY row_number() OVER (PARTITION BY last_day ORDER BY uses DESC, team) <= 3""")
def usage_sliding_top(d):
    """The three busiest teams of the seven days up to each day; the summaries keep twenty teams a day."""
    team = (F.col("user_id") % (1 + F.col("user_id") % 50)).alias("team")
    log = d.table("events").select("ts", team)
    days = stage(heavy_hitters.summarize_days(log, ["team"], keep=20), "days")
    found = heavy_hitters.sliding_top(log, days, ["team"], top=3)
    return found.select(F.col("last_day").cast("string").alias("last_day"), "team", "uses", "certain")
