"""Tags for columns whose values or names look like personal data."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.operators.sampling import sample_percent


class Rule(NamedTuple):
    tag: str
    name_pattern: str | None
    value_pattern: str | None
    #: what a value holds wherever the pattern matches; looked for first, as it is cheaper
    literal: str | None = None
    #: name of the check digits in ``CHECKS`` that a match must have
    check: str | None = None


def luhn(number: Column) -> Column:
    """Whether digits, with blanks or hyphens between them, end in their check digit."""
    return F.call_function("luhn_check", F.regexp_replace(number, "[ -]", ""))


def mod_97(number: Column) -> Column:
    """Whether an account number with its country and two check digits in front leaves 1 when divided by 97."""
    turned = F.concat(F.substring(number, 5, 34), F.substring(number, 1, 4))

    def step(left: Column, place: Column) -> Column:
        code = F.ascii(turned.substr(place, F.lit(1)))
        return F.when(code < 58, (left * 10 + code - 48) % 97).otherwise((left * 100 + code - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


CHECKS = {"luhn": luhn, "mod 97": mod_97}


def matches(rule: Rule, column: Column) -> Column:
    """Whether a value holds what the rule looks for: its literal, its pattern, and a match with right check digits."""
    if rule.check:
        found = F.exists(F.regexp_extract_all(column, F.lit(rule.value_pattern), F.lit(0)), CHECKS[rule.check])
    else:
        found = column.rlike(rule.value_pattern)
    return F.when(F.contains(column, F.lit(rule.literal)), found).otherwise(False) if rule.literal else found


RULES = [
    Rule("Email", r"(?i)e?mail", r"[A-Za-z0-9._%+-]@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    Rule("Phone", r"(?i)phone|mobile", r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}"),
    Rule("SocialSecurity", r"(?i)ssn|social", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"),
    Rule("CreditCard", r"(?i)card_?num", r"\b[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}\b"),
    Rule("IpAddress", r"(?i)ip_?addr", r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b"),
    Rule("BirthDate", r"(?i)dob|birth", None),
    Rule("PersonName", r"(?i)(full|first|last)?_?name$", None),
    Rule("Address", r"(?i)address|zip|city", None),
]
#: Numbers that count only with right check digits, and mail addresses behind their literal.
CHECKED_RULES = [
    Rule("Email", None, r"[A-Za-z0-9._%+-]@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", literal="@"),
    Rule("CreditCard", None, r"\b[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}\b", check="luhn"),
    Rule("BankAccount", None, r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\b", check="mod 97"),
]


def classify_columns(
    df: DataFrame,
    rules: list[Rule] = RULES,
    key: str | None = None,
    sample_pct: int = 100,
    min_ratio: float = 0.5,
) -> DataFrame:
    """``(column_name, tag, matched_by, match_ratio)`` of the text columns that a rule fits.

    A rule fits by the column name, or by at least ``min_ratio`` of the non-NULL values.
    All rules over all columns are counted in one aggregate over one scan of the sample.
    """
    if sample_pct < 100:
        df = sample_percent(df, key, sample_pct)
    columns = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    counts, rows = [F.lit(1).alias("_one")], []
    for i, c in enumerate(columns):
        col = F.col(f"`{c}`")
        counts.append(F.count(col).alias(f"_n{i}"))
        for j, rule in enumerate(rules):
            by_name = bool(rule.name_pattern) and F.lit(c).rlike(rule.name_pattern)
            if rule.value_pattern:
                counts.append(F.count_if(matches(rule, col)).alias(f"_m{i}_{j}"))
            hits = F.col(f"_m{i}_{j}") if rule.value_pattern else F.lit(0).cast("bigint")
            rows.append(F.struct(
                F.lit(c).alias("column_name"),
                F.lit(rule.tag).alias("tag"),
                (by_name if rule.name_pattern else F.lit(False)).alias("by_name"),
                (hits.cast("double") / F.nullif(F.col(f"_n{i}"), F.lit(0).cast("bigint"))).alias("match_ratio"),
            ))
    found = df.agg(*counts[1:]).select(F.inline(F.array(*rows)))
    by_value = F.coalesce(F.col("match_ratio") >= min_ratio, F.lit(False))
    return found.where(F.col("by_name") | by_value).select(
        "column_name", "tag",
        F.when(by_value, "value").otherwise("name").alias("matched_by"),
        F.round("match_ratio", 6).alias("match_ratio"),
    )
