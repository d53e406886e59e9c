"""The functions and views under the names that SQL users know, as temporary functions and views."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions.dates import date_pattern
from recordloom.functions.json import safe_json
from recordloom.functions.labels import label_subtype
from recordloom.functions.text import COURT_FILE_PATTERN, UNKNOWN_COURT, to_bigint
from recordloom.operators.filters import exclude_keywords, filter_in, filter_not_in_or_null, null_sentinels, usable_document
from recordloom.operators.parties import explode_json_documents, unnest_party
from recordloom.plans import governance
from recordloom.plans.cases import label_with_lookup, project_case
from recordloom.schemas import CIVIL_SUBTYPES, CLEANED_COLUMNS, EXCLUDED_SYSTEMS



def _safe_to_date() -> str:
    """SQL text for templates of any order, from the patterns of the column form; another template is an error."""
    def read(order: tuple[str, ...]) -> str:
        parts = ", ".join(f"regexp_extract(date_str, r'{date_pattern(order)}', {order.index(p) + 1})" for p in ("YYYY", "MM", "DD"))
        return f"WHEN '{''.join(order)}' THEN try_to_date(concat_ws('-', {parts}), 'y-M-d')"

    arms = " ".join(read(order) for order in permutations(("YYYY", "MM", "DD")))
    return f"CASE regexp_replace(format, '[^0-9A-Za-z]', '') {arms} ELSE raise_error(concat('unknown date template ', format)) END"


# fixed values: the names under which SQL users know the functions
_FUNCTIONS = {
    "safe_to_date(date_str STRING, format STRING) RETURNS DATE": _safe_to_date(),
    "nullif_na(text_str STRING) RETURNS STRING": "CASE WHEN text_str NOT IN ('NA', '') THEN text_str END",
    "extract_court_from_filename(filename STRING) RETURNS STRING": f"""
        CASE WHEN filename IS NOT NULL THEN
          coalesce(nullif(regexp_extract(filename, r'{COURT_FILE_PATTERN}', 1), ''), '{UNKNOWN_COURT}')
        END""",
    "calculate_file_hash(content STRING) RETURNS STRING": "md5(content)",
    "safe_json(text_str STRING) RETURNS STRING": r"""
        CASE WHEN size(from_json(concat('[', text_str, ',"', cast(xxhash64(text_str) AS STRING), '"]'), 'array<string>',
                                 map('allowSingleQuotes', 'false', 'allowNonNumericNumbers', 'false'))) = 2
              AND from_json(concat('[', text_str, ',"', cast(xxhash64(text_str) AS STRING), '"]'), 'array<string>',
                            map('allowSingleQuotes', 'false', 'allowNonNumericNumbers', 'false'))[1]
                  = cast(xxhash64(text_str) AS STRING)
              AND NOT text_str RLIKE r'(?<!\\)(?:\\\\)*\\u0000'
             THEN text_str END""",
}


def register_functions(spark: SparkSession) -> None:
    """Temporary SQL functions; plain expressions, so the optimizer inlines them."""
    for signature, body in _FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")


def case_views(source: DataFrame, case_types: DataFrame) -> dict[str, DataFrame]:
    """Every step of the case pipeline by name. Lazy: a view that is not queried costs nothing."""
    v: dict[str, DataFrame] = {}
    v["vw_label_cases"] = label_with_lookup(source, case_types)

    def with_category(rows: DataFrame, mode: str) -> DataFrame:
        return rows.withColumn("category", label_subtype(F.col("subtype"), mode)).drop("subtype")

    def documents(rows: DataFrame, column: str) -> DataFrame:
        return rows.where(usable_document(F.col(column))).select(
            to_bigint(F.col("id")).alias("row_id"), safe_json(F.col(column)).alias(column)
        )

    def elements(rows: DataFrame, column: str) -> DataFrame:
        return explode_json_documents(rows, column, {}, [to_bigint(F.col("id")).alias("row_id")], element=column)

    v["vw_limit_by_subtype"] = with_category(filter_in(v["vw_label_cases"], "subtype", CIVIL_SUBTYPES), "A")
    v["vw_real_nulls"] = null_sentinels(v["vw_limit_by_subtype"], CLEANED_COLUMNS)
    v["vw_drop_extras"] = exclude_keywords(v["vw_real_nulls"], "court_system", EXCLUDED_SYSTEMS).where(F.col("cjis").isNull())
    v["vw_save_off_the_non_civil"] = with_category(filter_not_in_or_null(v["vw_label_cases"], "subtype", CIVIL_SUBTYPES), "B")
    v["vw_fix_the_nulls_here_too"] = null_sentinels(v["vw_save_off_the_non_civil"], CLEANED_COLUMNS)
    system = F.col("court_system")
    v["vw_catch_the_remaining_civil_cases"] = v["vw_fix_the_nulls_here_too"].where(system.contains("CIVIL"))
    v["vw_remaining_civil_cases_2"] = v["vw_fix_the_nulls_here_too"].where(
        ~system.contains("CIVIL") & F.upper(system).contains("CIVIL")
    )
    v["vw_case_table"] = project_case(v["vw_drop_extras"]).distinct()
    v["vw_extra_case"] = project_case(v["vw_catch_the_remaining_civil_cases"]).distinct()
    v["vw_extra_case_2"] = project_case(v["vw_remaining_civil_cases_2"]).distinct()
    v["vw_all_cases"] = v["vw_case_table"].unionByName(v["vw_extra_case"]).unionByName(v["vw_extra_case_2"])
    for party in ("defendant", "plaintiff"):
        for rows, prefix, unpacked in (
            ("vw_drop_extras", "vw_", f"vw_unpack_{party}_json"),
            ("vw_catch_the_remaining_civil_cases", "vw_extra_", f"vw_unpack_extra_{party}s"),
        ):
            v[f"{prefix}{party}_json"] = documents(v[rows], party)
            v[f"{prefix}{party}_array"] = elements(v[rows], party)
            v[unpacked] = unnest_party(v[rows], party)
        v[f"vw_all_{party}s"] = v[f"vw_unpack_{party}_json"].unionByName(v[f"vw_unpack_extra_{party}s"])
    return v


def governance_views(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return {
        "vw_catalog_dataset": governance.catalog_dataset(t),
        "vw_permissible_use": governance.permissible_use(t),
        "vw_permissible_use_condition": governance.permissible_use_conditions(t),
        "vw_governance_assignments": governance.governance_assignments(t),
        "vw_data_access_request": governance.data_access_requests(t),
    }


def register_views(views: dict[str, DataFrame]) -> None:
    for name, df in views.items():
        df.createOrReplaceTempView(name)
