"""Functions on literal edge cases."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from recordloom.functions import (
    court_from_filename, label_subtype, nullif_na, null_if_in, safe_json, safe_to_date, surrogate_key,
    threshold_status, to_bigint,
)
from recordloom.operators.parties import unnest_party

D = dt.date


def one(spark, value, build, kind="string"):
    df = spark.createDataFrame([(value,)], f"v {kind}")
    return df.select(build(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("text, expected", [
    ("2020-01-05", D(2020, 1, 5)), ("2020-1-5", D(2020, 1, 5)), ("2020-01-05T00:00:00", D(2020, 1, 5)),
    ("  2020-01-05 and more", D(2020, 1, 5)), ("2020-02-30", None), ("2020-13-45", None), ("2024-02-29", D(2024, 2, 29)),
    ("", None), ("NA", None), (None, None), ("soon", None),
])
def test_iso_date(spark, text, expected):
    assert one(spark, text, safe_to_date) == expected


@pytest.mark.parametrize("text, expected", [
    ("01/05/2020", D(2020, 1, 5)), ("1/5/2020", D(2020, 1, 5)), ("02/30/2020", None), ("2020-01-05", None), (None, None),
])
def test_us_date(spark, text, expected):
    assert one(spark, text, lambda c: safe_to_date(c, "MM/DD/YYYY")) == expected


@pytest.mark.parametrize("text, template, expected", [
    ("31.12.2021 x", "DD.MM.YYYY", D(2021, 12, 31)), ("2021/1/2", "YYYY/MM/DD", D(2021, 1, 2)), ("2021-1-2", "YYYY/MM/DD", D(2021, 1, 2)), ("2020/01/05", "YYYY-MM-DD", D(2020, 1, 5)),
    ("2020 . 1 . 5", "YYYY-MM-DD", D(2020, 1, 5)), ("20200105", "YYYY-MM-DD", D(2020, 1, 5)),
])
def test_other_templates(spark, text, template, expected):
    assert one(spark, text, lambda c: safe_to_date(c, template)) == expected


def test_incomplete_template():
    with pytest.raises(ValueError):
        safe_to_date(None, "YYYY-MM")


VALID = ['{"Name":"~end~"}', '{"Name":"a"}', '[{"Name":"a"}]', "[]", "null", "5", '"s"', " [1, 2] ", '{"a":{"b":[1]}}', '["]"]', '{"a":"\\\\u0000"}']
INVALID = [
    None, "", "NA", "{bad", "[1] x", "1] x", "1],[2", "1,2", '{"a":1} {"b":2}', "{'Name':'x'}", '{"a":NaN}', '{"a":01}',
    "[1,]", '{"a":1,}', '{"a":1} // c', '"\\u0000"', '1,"~end~"] x',
]


@pytest.mark.parametrize("text", VALID)
def test_valid_json(spark, text):
    assert one(spark, text, safe_json) == text


@pytest.mark.parametrize("text", INVALID)
def test_invalid_json(spark, text):
    assert one(spark, text, safe_json) is None


NONE = (None,) * 11


@pytest.mark.parametrize("text, expected", [
    ('{"Name":"a","City":"X"}', [("a", "X")]),
    ('[{"Name":"a"},{"Name":"b","City":"Y"}]', [("a", None), ("b", "Y")]),
    ("[]", []), ("null", [(None, None)]), ("[5]", [(None, None)]), ('"s"', [(None, None)]), ("[null]", [(None, None)]),
    ('[{"Name":"a"},5]', [("a", None), (None, None)]), ('[[{"Name":"q"}]]', [(None, None)]),
    ('{"Name":"b","Name":"c"}', [("c", None)]), ('{"Name":1.0,"City":true}', [("1.0", "true")]),
    ('{"Name":null}', [(None, None)]), ('{"name":"lower"}', [(None, None)]),
    ("{bad", []), ("NA", []), ("", []), (None, []),
])
def test_unnest(spark, rows, text, expected):
    df = spark.createDataFrame([("7", text)], "id string, doc string")
    assert rows(unnest_party(df, "doc"), "name", "city") == sorted(expected, key=lambda t: [(v is not None, str(v)) for v in t])


def test_unnest_all_fields(spark):
    doc = (
        '{"Name":"n","City":"c","State":"s","Zip Code":"z","Address":"a","Address1":"a1","Amount":"a2","Party No.":"1",'
        '"Party Type":"t","Business or Organization Name":"o","Removal Date":"01/05/2020"}'
    )
    row = unnest_party(spark.createDataFrame([("7", doc)], "id string, doc string"), "doc").first()
    assert tuple(row) == (7, "n", "c", "s", "z", "a", "a1", "a2", "1", "t", "o", D(2020, 1, 5))


@pytest.mark.parametrize("subtype, a, b, v2", [
    ("D", "DEBT", "DEBT", "DEBT"), ("E", "EVICTION", "EVICTION", "EVICTION"), ("PD", "POSSIBLE DEBT", "POSSIBLE DEBT", "POSSIBLE DEBT"),
    ("PE", "POSSIBLE EVICTION", "POSSIBLE EVICTION", "POSSIBLE EVICTION"), ("PE, PD", "UNDETERMINED", "UNDETERMINED", "UNDETERMINED"),
    ("PD, PE", "UNDETERMINED", "UNDETERMINED", "UNDETERMINED"), ("X", None, "OTHER CIVIL", "OTHER CIVIL"),
    ("Q", None, "NO INFORMATION", "UNKNOWN"), (None, "NO INFORMATION", "NO INFORMATION", "NO INFORMATION"),
])
def test_labels(spark, subtype, a, b, v2):
    for mode, expected in (("A", a), ("B", b), ("V2", v2)):
        assert one(spark, subtype, lambda c: label_subtype(c, mode)) == expected


def test_sentinels(spark):
    assert [one(spark, v, null_if_in) for v in ("NA", "", "x", None)] == [None, "", "x", None]
    assert [one(spark, v, nullif_na) for v in ("NA", "", "x", None)] == [None, None, "x", None]


@pytest.mark.parametrize("name, court", [
    ("Court Data_20220928_Alder County Circuit Court.csv", "Alder County Circuit Court"),
    ("other.csv", "Unknown Court"), (None, None), ("x_Birch County District Court.csv.bak", "Unknown Court"),
])
def test_court(spark, name, court):
    assert one(spark, name, court_from_filename) == court


def test_bigint(spark):
    assert one(spark, " 12 ", to_bigint) == 12
    assert one(spark, "x1", lambda c: to_bigint(c, "null")) is None
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        one(spark, "x1", to_bigint)


def test_surrogate_key_tells_null_from_text(spark):
    keys = {one(spark, v, surrogate_key) for v in (None, "", "~", "=", "NULL")}
    assert len(keys) == 5


def test_threshold(spark):
    assert [one(spark, v, lambda c: threshold_status(c, 300), "int") for v in (301, 300, 1, 0)] == ["OK", "WARN", "WARN", "FAIL"]


def _strict(text):
    """What a strict parser makes of the text, as a list of elements, or None."""
    def refuse(constant):
        raise ValueError(constant)

    try:
        value = json.loads(text, parse_constant=refuse)
    except ValueError:
        return None
    return value if isinstance(value, list) else [value]


def _documents(rnd, n):
    def value(depth):
        kind = rnd.randrange(9 if depth < 2 else 5)
        if kind < 4:
            return "".join(rnd.choice('abÉ"\\/{}[],:\' 01') for _ in range(rnd.randrange(6)))
        if kind == 4:
            return rnd.choice([None, True, 7, -3])
        if kind < 7:
            return {rnd.choice(["Name", "City", "Party No.", "x"]): value(depth + 1) for _ in range(rnd.randrange(4))}
        return [value(depth + 1) for _ in range(rnd.randrange(4))]

    for _ in range(n):
        text = json.dumps(value(0), ensure_ascii=rnd.random() < 0.3)
        for _ in range(rnd.choice([0, 0, 1, 2])):
            at = rnd.randrange(len(text) + 1)
            text = text[:at] + rnd.choice(["", "]", "}", ",", "[", "{", '"', " ", "1", "\\"]) + text[at + rnd.randrange(2):]
        yield text


def test_unnest_against_a_strict_parser(spark):
    rnd = random.Random(17)
    texts = [t for t in dict.fromkeys(_documents(rnd, 3000)) if t not in ("", "NA")]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, doc string")
    got = {}
    for r in unnest_party(df, "doc").select("row_id", "name", "city", "party_num").collect():
        got.setdefault(r["row_id"], []).append((r["name"], r["city"], r["party_num"]))
    valid = {r["id"] for r in df.where(safe_json(F.col("doc")).isNotNull()).collect()}

    def shown(v):
        if v is None or isinstance(v, str):
            return v
        return json.dumps(v, separators=(",", ":"), ensure_ascii=False)

    def fields(e):
        return tuple(shown(e.get(k)) for k in ("Name", "City", "Party No.")) if isinstance(e, dict) else (None,) * 3

    wrong = []
    for i, text in enumerate(texts):
        elements = _strict(text)
        if (str(i) in valid) != (elements is not None):
            wrong.append((text, "valid" if str(i) in valid else "invalid"))
        elif [fields(e) for e in elements or []] != got.get(i, []):
            wrong.append((text, got.get(i)))
    assert not wrong, (len(wrong), wrong[:10])
    assert 500 < len(valid) < len(texts) - 500
