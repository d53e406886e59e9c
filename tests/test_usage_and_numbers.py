import random
from collections import Counter
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from recordloom.plans import classify, heavy_hitters

DAY = date(2024, 5, 1)


def log_of(spark, days=12, rows=900):
    dice = random.Random(2)
    data = [(datetime(2024, 5, 1) + timedelta(days=dice.randrange(days), seconds=dice.randrange(86_000)), k if k % 9 else None, "x")
            for k in (int(dice.paretovariate(0.7)) for _ in range(rows))]
    return data, spark.createDataFrame(data, "ts timestamp, key long, kind string")


def exact(data, last, days):
    return Counter(k for ts, k, _ in data if last - timedelta(days=days) < ts.date() <= last)


def test_sliding_top_with_whole_summaries(spark):
    data, log = log_of(spark)
    summaries = heavy_hitters.summarize_days(log, ["key", "kind"])
    assert summaries.where("dropped > 0").count() == 0
    got = heavy_hitters.sliding_top(log, summaries, ["key", "kind"], days=5, top=4).collect()
    windows = {r.last_day for r in got}
    assert windows == {ts.date() for ts, _, _ in data}  # no window after the last day
    for last in windows:
        order = sorted(exact(data, last, 5).items(), key=lambda kv: (-kv[1], kv[0] is not None, kv[0] or 0))[:4]
        rows = sorted((r for r in got if r.last_day == last), key=lambda r: (-r.uses, r.key is not None, r.key or 0))
        assert [(r.key, r.uses) for r in rows] == order and all(r.certain for r in rows)


def test_short_summaries_say_what_they_may_miss(spark):
    data, log = log_of(spark)
    summaries = heavy_hitters.summarize_days(log, ["key"], keep=3)
    assert summaries.groupBy("day").count().where("count > 3").count() == 0
    got = heavy_hitters.sliding_top(log, summaries, ["key"], days=7, top=5).collect()
    for last in {r.last_day for r in got}:
        want, rows = exact(data, last, 7), [r for r in got if r.last_day == last]
        assert all(r.uses == want[r.key] for r in rows)  # counted again, so exact
        found = {r.key for r in rows}
        assert all(n <= rows[0].missed_at_most for k, n in want.items() if k not in found and n > min(r.uses for r in rows))
        certain = {r.key for r in rows if r.certain}
        assert certain <= {k for k, n in want.items() if sum(m > n for m in want.values()) < 5}
    assert any(r.certain for r in got) and not all(r.certain for r in got)


def test_sliding_top_of_nothing(spark):
    log = log_of(spark)[1].where("false")
    summaries = heavy_hitters.summarize_days(log, ["key"])
    assert heavy_hitters.sliding_top(log, summaries, ["key"]).count() == 0


def test_numbers_need_right_check_digits(spark):
    rows = [
        ("card 4111 1111 1111 1111 here", True, False), ("card 4111 1111 1111 1112 here", False, False), ("5500-0000-0000-0004", True, False),
        ("4111 1111 1111 1112 and 4012888888881881", True, False), ("pay DE89370400440532013000 now", False, True),
        ("pay DE88370400440532013000 now", False, False), ("GB82WEST12345698765432", False, True), ("GB82WEST1234569876543", False, False),
        ("", False, False), ("41111111111111111", False, False), (None, None, None),
    ]
    _, card, account = classify.CHECKED_RULES
    df = spark.createDataFrame(rows, "text string, card boolean, account boolean")
    for row in df.select("*", classify.matches(card, F.col("text")).alias("c"), classify.matches(account, F.col("text")).alias("a")).collect():
        assert (row.c, row.a) == (row.card, row.account), row.text
    tags = {r.tag: r.match_ratio for r in classify.classify_columns(df.select("text"), classify.CHECKED_RULES, min_ratio=0.1).collect()}
    assert tags == {"CreditCard": 0.3, "BankAccount": 0.2}


def test_literal_in_front_changes_nothing(spark):
    df = spark.createDataFrame([("a@b.org",), ("a at b.org",), ("@",), (None,), ("",)], "v string")
    rule = classify.CHECKED_RULES[0]
    plain = rule._replace(literal=None)
    got = df.select(classify.matches(rule, F.col("v")).alias("a"), F.col("v").isNotNull() & classify.matches(plain, F.col("v")).alias("b")).collect()
    assert [bool(r[0]) for r in got] == [bool(r[1]) for r in got] == [True, False, False, False, False]
