"""One test per behaviour quirk, on the hand-made documents of FIXTURES.md §3."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ledger_rows import GID, rows
from potluck.operators import aggregates as A
from potluck.operators import debts as D
from potluck.operators.exclusions import ExclusionRules, exclusion_counts
from potluck.operators.trends import mom_full
from potluck.operators.widen import owes_text, widen
from potluck.plans.ledger import LedgerParams, with_exclusions


def test_kept_expenses_and_cost_without_comma_stripping(mini):
    # Q1 settlements dropped, F1 deleted dropped, Q14 "1,234.5" cost → 0, Q15 undated kept
    got = rows(mini.expenses, "expense_id", "amount", "month", "category")
    assert [(i, float(a), m, c) for i, a, m, c in got] == [
        (1, 100.0, "2024-01", "Groceries"), (2, 0.0, "2024-01", "Uncategorized"),
        (4, 80.0, "2024-03", "Trips"), (6, 5.0, "None", "Groceries")]


def test_shares_keep_settlements_drop_deleted_and_undated(mini):
    got = rows(mini.shares, "expense_id", "user_id", "person", "owed_share", "paid_share")
    assert len(got) == 8
    assert {r[0] for r in got} == {1, 2, 3, 4}
    assert (2, 101, "Alice", 1000.5, 0.0) in [(a, b, c, float(d), float(e)) for a, b, c, d, e in got]
    assert (4, 103, "103", 0.0, 80.0) in [(a, b, c, float(d), float(e)) for a, b, c, d, e in got]


def test_month_category(mini):
    got = rows(A.month_category(mini.expenses), "month", "category", "amount")
    assert got == [("2024-01", "Groceries", 100.0), ("2024-01", "Uncategorized", 0.0),
                   ("2024-03", "Trips", 80.0), ("None", "Groceries", 5.0)]


def test_person_month_owed_zero_filled_with_total(mini):
    got = rows(A.person_month_owed(mini.shares, mini.members), "month", "person", "amount")
    assert got == [("2024-01", "Alice", 1110.5), ("2024-01", "Bob", 40.0), ("2024-01", "Total", 1150.5),
                   ("2024-03", "Alice", 80.0), ("2024-03", "Bob", 0.0), ("2024-03", "Total", 80.0)]


def test_person_month_net_is_clipped_per_row(mini):
    rev = rows(A.person_month_net(mini.shares, mini.members, "reverse"), "month", "person", "amount")
    assert ("2024-01", "Alice", 40.0) in rev and ("2024-01", "Bob", 1050.5) in rev
    assert ("2024-03", "Alice", 0.0) in rev and ("2024-03", "Bob", 0.0) in rev
    norm = rows(A.person_month_net(mini.shares, mini.members, "normal"), "month", "person", "amount")
    assert ("2024-01", "Alice", 1050.5) in norm and ("2024-01", "Bob", 40.0) in norm
    assert ("2024-03", "Alice", 80.0) in norm and ("2024-03", "Bob", 0.0) in norm


def test_widen_owed_has_every_member(mini):
    wide = widen(mini.expenses, mini.shares, mini.members, F.col("owed_share"))
    assert rows(wide.withColumn("owes", owes_text()), "expense_id", "owes") == [
        (1, "Alice=60.0, Bob=40.0"), (2, "Alice=1000.5, Bob=0.0"), (4, "Alice=80.0, Bob=0.0"), (6, "Alice=0.0, Bob=0.0")]


def test_month_over_month_on_zero_filled_grid(mini):
    got = rows(mom_full(mini.expenses).where(F.col("category") == "Groceries"), "month", "value", "delta", "pct")
    assert got == [("2024-01", 100.0, None, 0.0), ("2024-03", 0.0, -100.0, -1.0), ("None", 5.0, 5.0, 0.0)]


def test_category_totals_and_bars(mini):
    from potluck.operators.bars import bars
    assert rows(A.category_totals(mini.expenses), "category", "amount") == [("Groceries", 105.0), ("Trips", 80.0)]
    s = mini.expenses.groupBy("group_id", "category").agg(F.sum("amount").alias("amount"))
    got = rows(bars(s, "category", [F.col("amount").desc(), F.col("category")], 20, color=True),
               "pos", "label", "amount", "pct")
    assert got == [(0, "Groceries", 105.0, 100.0), (1, "Trips", 80.0, 76.2)]


def test_exclusions_and_semi_join_side_effect(mini):
    a = with_exclusions(mini, ExclusionRules.of("2024-03", "paris, trip"))
    assert a.expenses.count() == 3 and a.shares.count() == 4
    b = with_exclusions(mini, ExclusionRules.of(" 2024-03 ,", "paris,food"))
    assert b.expenses.count() == 4 and b.shares.count() == 6
    c = with_exclusions(mini, ExclusionRules.of("", "paris"))  # inactive: identity
    assert c.expenses.count() == 4 and c.shares.count() == 8
    cnt = exclusion_counts(mini.raw_expenses, mini.raw_shares, ExclusionRules.of("2024-03", "paris,trip")).collect()[0]
    assert (cnt.expenses_removed, cnt.shares_removed) == (1, 4)


def test_search_spans_fields(mini):
    from potluck.operators.tables import raw_table, search
    wide = raw_table(widen(mini.expenses, mini.shares, mini.members, A.net_owes("reverse")))
    assert rows(search(wide, "  Market groceries 100.0 ILS "), "expense_id") == [(1,)]
    assert rows(search(wide, "1 40.0 0.0"), "expense_id") == [(1,)]      # id, then the members' amounts
    assert search(wide, " ").count() == 4


def test_summary_and_months(mini):
    s = A.summary(mini.expenses).collect()[0]
    assert (s.expense_count, s.total_expenses, s.currencies) == (4, 185.0, "EUR,ILS")
    assert A.multi_currency(mini.expenses).collect()[0].multi_currency is True
    months = rows(A.distinct_values(mini.expenses).where("kind = 'month'"), "value")
    assert sorted(months, reverse=True) == [("None",), ("2024-03",), ("2024-01",)]


def test_filter_fallbacks(mini):
    from potluck.plans.views import selected_category, selected_month
    assert selected_month(mini.expenses, "1999-01").collect()[0].month == "all"
    assert selected_month(mini.expenses, "2024-03").collect()[0].month == "2024-03"
    assert selected_category(mini.expenses, "Nope").collect()[0].category == "Groceries"
    assert selected_category(mini.expenses, "Trips").collect()[0].category == "Trips"


def test_person_month_groups(mini):
    from potluck.operators.bars import person_month_groups
    from potluck.plans.snapshot import Snapshot
    pm = A.person_month(mini.shares, mini.members, A.net_owes("reverse")).drop("ord")
    months = Snapshot(mini).months()
    got = rows(person_month_groups(pm, months), "month_rank", "month", "person", "pct")
    assert got == [(1, "2024-03", "Alice", 0.0), (1, "2024-03", "Bob", 0.0),
                   (2, "2024-01", "Alice", 3.8), (2, "2024-01", "Bob", 100.0)]
    only = rows(person_month_groups(pm, months, "2024-03"), "person", "pct")
    assert only == [("Alice", 0.0), ("Bob", 0.0)]


def test_label_color(spark):
    from potluck.functions.format import format_money, label_color
    r = spark.range(1).select(label_color(F.lit("Food")).alias("c"), label_color(F.lit("")).alias("u"),
                              format_money(F.lit(1234.5)).alias("m"), format_money(F.lit(-5)).alias("n")).collect()[0]
    assert r.c == "hsl(238deg 75% 41%)"
    assert r.u == spark.range(1).select(label_color(F.lit("unknown"))).collect()[0][0]
    assert (r.m, r.n) == ("₪1,234.50", "₪-5.00")


def test_debt_edges_and_balances(mini):
    edges = D.debt_edges(mini.debts_raw, mini.members, "reverse")
    assert rows(edges, "from_name", "to_name", "amount", "pos") == [("Alice", "103", 12, 1), ("Bob", "Alice", 30, 0)]
    top = D.top_debt(edges).collect()[0]
    assert (top.from_name, top.to_name) == ("Bob", "Alice")
    bal = rows(D.member_balances(edges, mini.members), "name", "owes", "to_receive")
    assert bal == [("Alice", 12.0, 30.0), ("Bob", 30.0, 0.0)]
    normal = D.debt_edges(mini.debts_raw, mini.members, "normal")
    assert rows(D.member_balances(normal, mini.members), "name", "owes", "to_receive") == [
        ("Alice", 30.0, 12.0), ("Bob", 0.0, 30.0)]
    assert rows(D.debtor_totals(mini.debts_raw, mini.members), "person", "amount") == [("Alice", 30.0), ("Bob", -5.0)]


def test_direction_parameter_fallback():
    assert LedgerParams(debt_direction="sideways").debt_mode == "reverse"
    assert LedgerParams(debt_direction=" Normal ").debt_mode == "normal"
    assert LedgerParams(debt_direction="normal", share_direction="reverse").share_mode == "reverse"
    assert replace(LedgerParams(), debt_direction="normal").share_mode == "normal"


def test_scoped_month(mini):
    r = A.scoped_month(mini.expenses, "2024-01").collect()[0]
    assert (r.selected_month, r.scoped_count, r.scoped_total) == ("2024-01", 2, 100.0)
    r = A.scoped_month(mini.expenses, "1999-01").collect()[0]
    assert (r.selected_month, r.scoped_count, r.scoped_total) == ("all", 4, 185.0)
    assert GID == r.group_id


def test_exclusions_leave_groups_without_expenses_alone(spark, mini):
    # a group whose documents are all settlements has no expenses: its shares survive
    from potluck.operators.exclusions import apply_exclusions
    extra = mini.shares.where("expense_id = 3").withColumn("group_id", F.lit(GID + 1))
    e, s = apply_exclusions(mini.expenses, mini.shares.unionByName(extra), ExclusionRules.of("2024-03", "paris"))
    assert s.where(f"group_id = {GID + 1}").count() == 2
    assert s.where(f"group_id = {GID}").count() == 4


def test_single_group_tables_have_the_original_shape(mini):
    from potluck.plans.snapshot import Snapshot
    from potluck.plans.views import group_tables
    t = group_tables(Snapshot(mini), GID)
    mbc = t["monthly_by_category"]
    assert mbc.columns == ["month", "Groceries", "Trips", "Uncategorized", "Total"]
    assert [tuple(r) for r in mbc.collect()] == [("2024-01", 100.0, 0.0, 0.0, 100.0), ("2024-03", 0.0, 80.0, 0.0, 80.0),
                                                 ("None", 5.0, 0.0, 0.0, 5.0)]
    ppm = t["per_person_month"]
    assert ppm.columns == ["month", "Alice", "Bob", "Total"]
    assert [tuple(r) for r in ppm.collect()] == [("2024-03", 0.0, 0.0, 0.0), ("2024-01", 40.0, 1050.5, 1090.5)]
    raw = t["raw_expenses"]
    assert raw.columns == ["date", "month", "description", "category", "amount", "currency", "expense_id",
                           "Alice_owes", "Bob_owes"]
    assert [r.expense_id for r in raw.collect()] == [6, 4, 2, 1]


def test_dashboard_view_header(mini):
    from potluck.plans.snapshot import Snapshot
    from potluck.plans.views import dashboard_view, tables_view
    d = dashboard_view(Snapshot(mini), "1999-01", "2024-03", "Nope")
    h = d["header"].collect()[0]
    assert (h.selected_category_month, h.selected_person_month, h.selected_category) == ("all", "2024-03", "Groceries")
    assert (h.scoped_count, h.scoped_total) == (4, 185.0)
    assert (h.top_debt_from, h.top_debt_to, h.top_debt_amount) == ("Bob", "Alice", 30.0)
    assert (h.n_category_bars, h.n_monthly_bars, h.n_category_month_bars, h.n_person_months) == (2, 3, 2, 1)
    bars = [(r.label, r.pct, r.color is not None) for r in d["category_bars"].orderBy("pos").collect()]
    assert bars == [("Groceries", 100.0, True), ("Trips", 76.2, True)]
    t = tables_view(Snapshot(mini), "2024-01", "fuel", 10)
    th = t["header"].collect()[0]
    assert (th.selected_month, th.query, th.raw_total, th.raw_shown, th.table_limit) == ("2024-01", "fuel", 1, 1, 50)
