"""Cross-query invariants on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from potluck.operators import aggregates as A
from potluck.operators import debts as D
from potluck.plans.ledger import from_tables

SF = "/root/testdata/sf0.001"


def _by_group(df, col="amount"):
    return {r[0]: round(r[1], 2) for r in df.groupBy("group_id").agg(F.sum(col)).collect()}


def test_totals_agree(spark):
    led = from_tables(spark, SF)
    e = led.expenses
    grand = {r.group_id: round(r.total_expenses, 2) for r in A.summary(e).collect()}
    assert _by_group(A.monthly_totals(e)) == grand
    assert _by_group(A.month_category(e)) == grand
    cube = A.category_cube(e)
    assert _by_group(cube.where("month = 'All months'")) == grand


def test_grid_totals(spark):
    led = from_tables(spark, SF)
    grid = A.month_category_grid(led.expenses)
    bad = grid.groupBy("group_id", "month").agg(F.sum("amount").alias("s"), F.first("total").alias("t"))
    assert bad.where(F.abs(F.col("s") - F.col("t")) > 0.001).count() == 0


def test_owes_equal_receives_when_all_endpoints_are_members(spark):
    led = from_tables(spark, SF)
    edges = D.debt_edges(led.debts_raw, led.members, "reverse")
    member_ids = led.members.select("group_id", F.col("user_id").alias("from_id"))
    inner = edges.join(member_ids, ["group_id", "from_id"], "left_semi").join(
        led.members.select("group_id", F.col("user_id").alias("to_id")), ["group_id", "to_id"], "left_semi")
    bal = D.member_balances(inner, led.members).agg(F.sum("owes"), F.sum("to_receive")).collect()[0]
    assert round(bal[0], 2) == round(bal[1], 2)


def test_no_rules_is_identity(spark):
    from potluck.operators.exclusions import ExclusionRules, apply_exclusions
    led = from_tables(spark, SF)
    e, s = apply_exclusions(led.raw_expenses, led.raw_shares, ExclusionRules())
    assert e is led.raw_expenses and s is led.raw_shares
