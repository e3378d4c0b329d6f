"""Several groups in one job: members, keys, versions, money and months stay apart."""

from __future__ import annotations

import json
import uuid
from decimal import Decimal

from pyspark.sql import functions as F

from ledger_rows import rows
from potluck.operators import aggregates as A
from potluck.operators.widen import owes_text, widen
from potluck.plans.snapshot import Snapshot
from potluck.plans.views import group_tables, tables_view
from potluck.schemas import EXPENSE_DOC, GROUP_CONFIG
from potluck.session import shared_path
from potluck.sources.docs import ledger_from_docs, read_docs, rejected_docs

GROUPS = [(1, "one", '{"7": "Alice", "8": "Bob"}'), (2, "two", '{"8": "Zed"}')]


def doc(group, i, cost, category="Food", date="2024-01-05", stamp="2024-01-05", users=(), deleted=None, desc="x"):
    return {"group_id": group, "id": i, "date": date, "updated_at": stamp, "deleted_at": deleted, "cost": cost,
            "currency_code": "ILS", "description": desc, "category": {"name": category} if category else None,
            "users": [dict(u) for u in users]}


def user(uid, **amounts):
    return {"user_id": uid, **amounts}


def ledger(spark, docs, groups=GROUPS):
    return ledger_from_docs(spark.createDataFrame(docs, EXPENSE_DOC), spark.createDataFrame(groups, GROUP_CONFIG),
                            spark.createDataFrame([], "group_id long, `from` string, `to` string, amount string"))


def test_groups_do_not_see_each_other(spark):
    # id 1 stands in both groups
    led = ledger(spark, [doc(1, 1, "100", users=[user("7", owed_share="60"), user("8", owed_share="40")]),
                         doc(2, 1, "5", "Trips", users=[user("8", owed_share="5")])])
    wide = widen(led.expenses, led.shares, led.members, F.col("owed_share"))
    assert rows(wide.withColumn("owes", owes_text()), "group_id", "owes") == [(1, "Alice=60.0, Bob=40.0"), (2, "Zed=5.0")]
    docs = {r.group_id: json.loads(r.snapshot) for r in Snapshot(led).to_json().collect()}
    assert "Zed" not in json.dumps(docs[1]) and "Alice" not in json.dumps(docs[2])
    assert docs[1]["tables"]["monthly_by_category"] == {
        "columns": ["month", "Food", "Total"], "rows": [{"month": "2024-01", "Food": 100.0, "Total": 100.0}]}
    totals = A.person_totals_by_month(led.expenses, led.shares, led.members, "normal")
    assert rows(totals, "group_id", "person", "amount") == [(1, "Alice", 60.0), (1, "Bob", 40.0), (2, "Zed", 5.0)]


def test_group_without_rows_has_empty_parts(spark):
    led = ledger(spark, [doc(1, 1, "100")])
    two = next(json.loads(r.snapshot) for r in Snapshot(led).to_json().collect() if r.group_id == 2)
    assert two["months"] == [] and two["debt_edges"] == [] and two["charts"]["category_totals_by_month"] == {}
    assert two["summary"] == {"expense_count": 0, "total_expenses": 0.0, "currencies": []}
    assert two["range"] == {"start_month": None, "end_month": None}
    assert two["tables"]["recent_expenses"] == {"columns": [], "rows": []}
    assert two["tables"]["per_person_month"] == {"columns": [], "rows": []}
    assert [p["amount"] for p in two["charts"]["person_totals_all"]] == [0.0]


def test_two_thousand_names(spark):
    groups = [(g, f"g{g}", json.dumps({str(g * 10 + k): f"name {g}-{k}" for k in range(4)})) for g in range(500)]
    led = ledger(spark, [doc(g, g, "10", users=[user(str(g * 10), owed_share="10")]) for g in range(500)], groups)
    wide = widen(led.expenses, led.shares, led.members, F.col("owed_share"))
    assert wide.where(F.size("owes") != 4).count() == 0
    names = wide.select(F.explode("owes.name")).distinct().count()
    assert names == 2000
    assert Snapshot(led).to_json().count() == 500


def test_versions_before_anything_else(spark):
    led = ledger(spark, [
        doc(1, 1, "100", users=[user("7", owed_share="60")]), doc(1, 1, "100", users=[user("7", owed_share="60")]),
        doc(1, 2, "50"), doc(1, 2, "50", stamp="2024-02-01", deleted="2024-02-01"),
        doc(1, 3, "7", stamp="2024-01-02", desc="good"), doc(1, 3, "8", stamp=None, desc="stale"),
        doc(1, 4, "1", date="2024-01-09"), doc(1, 4, "1", date="2024-02-09", stamp="2024-03-01")])
    assert rows(led.expenses, "expense_id", "description", "month") == [
        (1, "x", "2024-01"), (3, "good", "2024-01"), (4, "x", "2024-02")]
    assert rows(A.person_month_owed(led.shares, led.members), "person", "amount") == [("Alice", 60.0), ("Total", 60.0)]
    moved = ledger_from_docs(spark.createDataFrame([doc(1, 4, "1", date="2024-01-09"), doc(1, 4, "1", date="2024-02-09", stamp="2024-03-01")],
                                                   EXPENSE_DOC), led.groups, led.debts_raw, start_ym="2024-01", end_ym="2024-01")
    assert moved.expenses.count() == 0


def test_money_is_neither_cut_nor_rounded_before_the_sum(spark):
    led = ledger(spark, [doc(1, i, "1.004") for i in range(1000)] + [doc(1, 5000, "1e17", "Big")])
    totals = {r.category: r.amount for r in A.category_totals(led.expenses).collect()}
    assert totals == {"Food": 1004.0, "Big": 1e17}
    from potluck.operators.debts import debtor_totals
    debts = spark.createDataFrame([(1, "7", "8", "0.004")] * 1000, "group_id long, `from` string, `to` string, amount string")
    assert rows(debtor_totals(debts, led.members).where("person = 'Alice'"), "amount") == [(4.0,)]


def test_every_spelling(spark):
    landed = shared_path(spark, "tests", "potluck-test-spellings", uuid.uuid4().hex)
    users = [{"user_id": 7, "owedShare": "60", "paid": "1,000"}, {"user": {"id": "8"}, "owed": "40", "paidShare": 2}]
    lines = [json.dumps({"group_id": 1, "id": 1, "date": "2024-01-05", "cost": 100, "users": users}),
             '{"group_id": 1, "id": 2, "date": "2024-01', "not json"]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(landed)
    docs = read_docs(spark, landed)
    assert docs.count() == 1 and rejected_docs(spark, landed).count() == 2
    led = ledger_from_docs(docs, spark.createDataFrame(GROUPS, GROUP_CONFIG),
                           spark.createDataFrame([], "group_id long, `from` string, `to` string, amount string"))
    assert [(r.person, r.owed_share, r.paid_share) for r in led.shares.orderBy("person").collect()] == [
        ("Alice", Decimal(60), Decimal(1000)), ("Bob", Decimal(40), Decimal(2))]
    from potluck.operators.debts import debt_edges
    from potluck.schemas import DEBTS_RAW
    spelled = spark.createDataFrame([{"group_id": 1, "from_user": "7", "to_user_id": "8", "amount": "3"}], DEBTS_RAW)
    assert rows(debt_edges(spelled, led.members, "normal"), "from_name", "to_name") == [("Alice", "Bob")]


def test_category_named_total(spark):
    led = ledger(spark, [doc(1, 1, "100"), doc(1, 2, "5", "Total")])
    from potluck.operators.trends import mom_full
    assert rows(mom_full(led.expenses).where("category = 'Total'"), "is_total", "value") == [(False, 5.0), (True, 105.0)]
    assert group_tables(Snapshot(led), 1)["monthly_by_category"].columns == ["month", "Food", "Total"]
    table = json.loads(Snapshot(led).to_json().where("group_id = 1").first().snapshot)["tables"]["monthly_by_category"]
    assert table["rows"] == [{"month": "2024-01", "Food": 100.0, "Total": 105.0}]


def test_month_filter_comes_from_the_expense_months(mini):
    snap = Snapshot(mini)
    undated = tables_view(snap, "None", None, None)                  # a month of expenses, not of shares
    assert undated["person"].count() == 0 and undated["monthly"].count() == 1
    payment_only = tables_view(snap, "2024-02", None, None)          # no expense has it: all months
    assert payment_only["header"].first().selected_month == "all"
    assert payment_only["person"].count() == 2 and payment_only["monthly"].count() == 3
    assert tables_view(snap, "all", "1090.5", None)["person"].count() == 1


def test_pivot_money_columns():
    from potluck.operators.tables import money_columns, pivot_money_columns
    assert money_columns(["date", "amount", "Alice_owes", "owes"]) == ["amount", "Alice_owes", "owes"]
    assert pivot_money_columns(["group_id", "month", "Food", "Total"]) == ["Food", "Total"]


def test_cluster_without_a_shared_folder_is_refused():
    import pytest
    from potluck.session import ensure_checkpoint_dir

    class Conf(dict):
        def get(self, key, default=None):
            return dict.get(self, key, default)

    class Context:
        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf({"spark.master": "yarn"}), Context()
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())
