"""Column helpers and source parsing: lenient numbers and ids, member maps, calendars."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledger_rows import GID
from potluck.functions.numbers import lenient_cost, lenient_long, lenient_money, py_float_text, resolve_user_id
from potluck.schemas import GROUP_CONFIG
from potluck.sources.calendar import in_months, month_start


def _one(spark, col, values, dtype="string"):
    df = spark.createDataFrame([(v,) for v in values], f"v {dtype}")
    return [r[0] for r in df.select(col(F.col("v"))).collect()]


def test_lenient_money_matches_python_float(spark):
    vals = [" 12 ", "1,000.5", "1e3", ".5", "-2.5", "1d", "0x10", "", None, "abc", "\t7\n"]
    got = [float(x) for x in _one(spark, lenient_money, vals)]
    assert got == [12.0, 1000.5, 1000.0, 0.5, -2.5, 0.0, 0.0, 0.0, 0.0, 0.0, 7.0]
    assert [float(x) for x in _one(spark, lenient_cost, ["1,234.5", "50", None])] == [0.0, 50.0, 0.0]


def test_resolve_user_id(spark):
    vals = ["12", " 12 ", "-3", "1.5", '{"id": 103}', '{"user_id": "7"}', '{"id": null, "user_id": 4}', "x", None]
    assert _one(spark, resolve_user_id, vals) == [12, 12, None, None, 103, 7, None, None, None]
    assert _one(spark, lenient_long, [" 12", "+5", "-3", "1e5", "x"]) == [12, 5, -3, None, None]


def test_python_float_text(spark):
    df = spark.createDataFrame([("100.00",), ("1234.50",), ("12.34",), ("0.00",)], "v string")
    got = [r[0] for r in df.select(py_float_text(F.col("v").cast("decimal(18,2)"))).collect()]
    assert got == ["100.0", "1234.5", "12.34", "0.0"]


def test_members_from_json_order_and_bad_config(spark):
    from potluck.sources.members import member_lists, members_from_config
    groups = spark.createDataFrame([(GID, "a", '{"5": "Zed", "1": "Amy", " 3 ": "Bo"}'),
                                    (GID + 1, "b", "[1, 2]"), (GID + 2, "c", "not json")], GROUP_CONFIG)
    m = members_from_config(groups)
    got = [(r.group_id, r.user_id, r.name, r.ord) for r in m.orderBy("group_id", "ord").collect()]
    assert got == [(GID, 5, "Zed", 1), (GID, 1, "Amy", 2), (GID, 3, "Bo", 3)]
    assert [(r.group_id, r.names) for r in member_lists(m).collect()] == [(GID, ["Zed", "Amy", "Bo"])]


def test_a_user_named_twice_counts_once(spark):
    from potluck.sources.members import members_from_config
    groups = spark.createDataFrame([(GID, "a", '{"5": "Zed", " 5": "Again", "1": "Amy"}')], GROUP_CONFIG)
    assert sorted(map(tuple, members_from_config(groups).select("user_id", "name").collect())) == [(1, "Amy"), (5, "Zed")]


def test_month_bounds(spark):
    row = spark.range(1).select(month_start("2024-12").cast("string"), month_start("2024-12", 1).cast("string")).first()
    assert tuple(row) == ("2024-12-01", "2025-01-01")
    days = spark.sql("select explode(sequence(date'2024-01-30', date'2024-04-02')) as d")
    inside = days.where(in_months(F.col("d"), "2024-02", "2024-03"))
    assert tuple(map(str, inside.agg(F.min("d"), F.max("d")).first())) == ("2024-02-01", "2024-03-31")
    assert days.where(in_months(F.col("d"), None, None)).count() == days.count()
    for start, end in (("2024-02", "2024-01"), ("2024-13", None), (None, "24-01")):
        with pytest.raises(ValueError):
            in_months(F.col("d"), start, end)


def test_group_calendar_fills_gaps(spark, mini):
    from potluck.sources.calendar import calendar_bounds, group_calendar
    cal = calendar_bounds(group_calendar(mini.expenses))
    got = [(r.month, r.start_date, r.end_date) for r in cal.orderBy("month").collect()]
    assert got == [("2024-01", "2024-01-01", "2024-02-01"), ("2024-02", "2024-02-01", "2024-03-01"),
                   ("2024-03", "2024-03-01", "2024-04-01")]


def test_person_pivots_omit_members_without_shares_but_widen_has_all(spark, mini):
    # Q12: a member with no share rows gets no pivot column, but a 0.0 column when widening
    from potluck.operators import aggregates as A
    from potluck.operators.widen import widen
    from potluck.plans.ledger import build
    from potluck.sources.members import members_from_config
    groups = spark.createDataFrame([(GID, "Home", '{"101": "Alice", "102": "Bob", "104": "Dana"}')], GROUP_CONFIG)
    members = members_from_config(groups)
    led = build(groups, members, mini.expenses, mini.shares, mini.debts_raw)
    persons = {r.person for r in A.person_month_owed(led.shares, led.members).collect()}
    assert persons == {"Alice", "Bob", "Total"}
    wide = widen(led.expenses, led.shares, led.members, F.col("owed_share"))
    assert {tuple(x.name for x in r.owes) for r in wide.collect()} == {("Alice", "Bob", "Dana")}
    assert {float(r.owes[2].amount) for r in wide.collect()} == {0.0}
    totals = {r.person: r.amount for r in A.person_totals(led.expenses, led.shares, led.members, "reverse").collect()}
    assert totals["Dana"] == 0.0


def test_first_present_falsy_fallthrough(spark):
    # Q22: dict-shaped payloads fall through empty values to the next spelling
    from potluck.operators.normalize import first_present
    df = spark.createDataFrame([("", "5", None), (None, None, "7"), ("3", "9", None)],
                               "owed_share string, owedShare string, owed string")
    got = [r[0] for r in df.select(first_present(df, ["owed_share", "owedShare", "owed"], truthy=True)).collect()]
    assert got == ["5", "7", "3"]
    assert [r[0] for r in df.select(first_present(df, ["missing"])).collect()] == [None, None, None]


def test_month_range_open_ends(spark, docs):
    from potluck.sources.docs import month_range
    assert sorted(r.id for r in month_range(docs, "2024-03", None).collect()) == [4, 5]
    assert sorted(r.id for r in month_range(docs, None, "2024-01").collect()) == [1, 2, 3]
    assert month_range(docs, None, None).count() == 6
    with pytest.raises(ValueError):
        month_range(docs, "2024-03", "2024-01")
