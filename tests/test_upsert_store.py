"""Upsert rules, legacy member columns, versioned publish and the export job."""

from __future__ import annotations

import uuid

import pytest
from pyspark.sql import functions as F

from potluck.session import shared_path
from ledger_rows import GID, rows
from potluck.operators.upsert import new_rows, upsert, with_position
from potluck.operators.widen import canonical_owes, fold_member_columns, owes_text, widen
from potluck.schemas import EXPENSE_STORE


def _store(spark):
    return spark.createDataFrame(
        [(GID, 1, "2024-01-05", "Old", "Groceries", 100.0, 55.0),
         (GID, 9, "2023-12-01", "Earlier", "Groceries", 7.0, 3.0)],
        "group_id long, expense_id long, date string, description string, category string, amount double, "
        "Alice_owes double")


def test_upsert_keeps_store_rows_and_non_null_cells(spark, mini):
    merged = upsert(_store(spark), mini.expenses)
    ordered = [r.expense_id for r in with_position(merged).orderBy("pos").collect()]
    assert ordered == [9, 1, 2, 4, 6]  # "None" date sorts last
    one = merged.where("expense_id = 1").collect()[0]
    assert one.description == "Market" and one.Alice_owes == 55.0
    assert merged.columns == sorted(merged.columns)
    rewidened = widen(merged.withColumn("owes", F.lit("stale")), mini.shares, mini.members, F.col("owed_share"))
    assert rows(rewidened.where("expense_id in (1, 9)").withColumn("owes", owes_text()), "expense_id", "owes") == [
        (1, "Alice=60.0, Bob=40.0"), (9, "Alice=0.0, Bob=0.0")]


def test_upsert_without_store_is_incoming(spark, mini):
    assert upsert(None, mini.expenses).count() == mini.expenses.count()
    assert set(upsert(None, mini.expenses).columns) == set(mini.expenses.columns)


def test_upsert_is_idempotent(spark, mini):
    once = upsert(_store(spark), mini.expenses)
    twice = upsert(once, mini.expenses)
    cols = sorted(once.columns)
    assert sorted(map(tuple, once.select(cols).collect()), key=str) == sorted(
        map(tuple, twice.select(cols).collect()), key=str)


def test_dedupe_keeps_latest_update(spark, mini):
    later = mini.expenses.where("expense_id = 1").withColumn("updated_at", F.lit("2025-01-01T00:00:00Z")) \
        .withColumn("description", F.lit("Newer"))
    merged = upsert(None, mini.expenses.unionByName(later))
    assert merged.where("expense_id = 1").collect()[0].description == "Newer"


def test_new_rows(spark, mini):
    assert rows(new_rows(_store(spark), mini.expenses), "expense_id") == [(2,), (4,), (6,)]


def test_new_expenses_compares_whole_tables(spark, mini, monkeypatch):
    from potluck import queries
    from potluck.operators import upsert as operators
    seen = {}
    monkeypatch.setattr(queries, "from_tables", lambda *_: mini)
    monkeypatch.setattr(operators, "new_rows", lambda store, incoming: seen.update(store=store, incoming=incoming) or new_rows(store, incoming))
    got = queries.QUERIES["new_expenses"](spark, "/nowhere")
    ids = sorted(r.expense_id for r in mini.expenses.collect())
    assert sorted(abs(r.expense_id) for r in seen["store"].collect()) == ids
    assert sorted(r.expense_id for r in seen["incoming"].collect()) == ids
    assert sorted(r.expense_id for r in got.collect()) == [i for i in ids if i % 3 == 2]


def test_legacy_columns(spark):
    from potluck.schemas import MEMBERS
    df = spark.createDataFrame([(GID, 1, 4.006, 9.0, 1.0)],
                               "group_id long, expense_id long, Alice_owed double, Alice_paid double, Bob_owes_y double")
    members = spark.createDataFrame([(GID, 5, "Alice", 1), (GID, 6, "Bob", 2), (GID, 7, "Eve", 3)], MEMBERS)
    out = canonical_owes(fold_member_columns(df, ["group_id", "expense_id"]), members)
    assert out.columns == ["group_id", "expense_id", "owes"]
    assert out.select(owes_text()).first()[0] == "Alice=4.01, Bob=1.0, Eve=0.0"


def test_unstamped_version_is_the_oldest(spark, mini):
    stale = mini.expenses.where("expense_id = 1").withColumn("updated_at", F.lit("None")).withColumn("description", F.lit("Stale"))
    merged = upsert(None, stale.unionByName(mini.expenses))
    assert merged.where("expense_id = 1").collect()[0].description == "Market"


def test_publish_and_latest_version(spark):
    from potluck.sinks import writers
    root = shared_path(spark, "tests", "potluck-test-pub", uuid.uuid4().hex)
    assert writers.read_published(spark, root, "t") is None
    writers.publish(spark, root, 1, {"t": spark.range(3)})
    # a version whose tables were written but never marked published is invisible
    writers.write_table(spark.range(5), f"{writers.version_path(root, 2)}/t")
    assert writers.list_versions(spark, root) == [1]
    assert writers.read_published(spark, root, "t").count() == 3
    writers.publish(spark, root, 2, {"t": spark.range(5)})
    assert writers.read_published(spark, root, "t").count() == 5
    assert writers.latest_version(spark, root, before=2) == 1


def test_export_job_round_trip(spark, mini):
    from potluck.plans.export import export
    from potluck.sinks import writers
    root = shared_path(spark, "tests", "potluck-test-export", uuid.uuid4().hex)
    res = export(spark, mini, root, version=1)
    raw = writers.read_published(spark, root, "raw_expenses", EXPENSE_STORE)
    assert raw.count() == 4
    assert set(res.tables) >= {"raw_expenses", "monthly_by_category", "per_person_month", "raw_shares"}
    # second run: store rows absent upstream stay; member columns re-derived
    export(spark, mini.with_params(mini.params), root, version=2)
    assert writers.read_published(spark, root, "raw_expenses", EXPENSE_STORE).count() == 4
    pp = writers.read_published(spark, root, "per_person_month")
    assert rows(pp.where("month = '2024-01'"), "person", "amount") == [
        ("Alice", 1110.5), ("Bob", 40.0), ("Total", 1150.5)]


def test_read_store_missing_and_present(spark, mini):
    from potluck.operators.upsert import read_store
    from potluck.schemas import EXPENSES
    root = shared_path(spark, "tests", "potluck-test-store", uuid.uuid4().hex)
    assert read_store(spark, f"{root}/nothing-here", EXPENSES) is None
    mini.expenses.write.parquet(f"{root}/store")
    assert read_store(spark, f"{root}/store", EXPENSES).count() == 4
    mini.expenses.limit(0).write.partitionBy("month").parquet(f"{root}/empty")
    assert read_store(spark, f"{root}/empty", EXPENSES).count() == 0


def test_export_of_settled_documents_only(spark, docs, mini):
    # every fetched expense is a settlement: the store is empty, and the next run works on it
    from potluck.plans.export import export
    from potluck.sinks import writers
    from potluck.sources.docs import ledger_from_docs
    root = shared_path(spark, "tests", "potluck-test-settled", uuid.uuid4().hex)
    settled = ledger_from_docs(docs.where("id = 3"), mini.groups, mini.debts_raw)
    export(spark, settled, root, version=1)
    assert writers.read_published(spark, root, "raw_expenses", EXPENSE_STORE).count() == 0
    export(spark, mini, root, version=2)
    assert writers.read_published(spark, root, "raw_expenses", EXPENSE_STORE).count() == 4


def test_stored_files_are_in_upsert_order(spark, mini):
    from potluck.plans.export import export
    from potluck.sinks import writers
    root = shared_path(spark, "tests", "potluck-test-order", uuid.uuid4().hex)
    more = mini.expenses.unionByName(mini.expenses.withColumn("expense_id", F.col("expense_id") + 100)
                                     .withColumn("date", F.lit("2024-01-01")).withColumn("month", F.lit("2024-01")))
    from potluck.plans.ledger import build
    export(spark, build(mini.groups, mini.members, more, mini.shares, mini.debts_raw), root, version=1)
    path = f"{writers.version_path(root, 1)}/raw_expenses/month=2024-01"
    stored = [(r.date, r.category, r.description) for r in spark.read.parquet(path).coalesce(1).collect()]
    assert len(stored) == 6 and stored == sorted(stored)


def test_republished_version_is_hidden_meanwhile_and_loses_old_tables(spark):
    from potluck.sinks import writers
    root = shared_path(spark, "tests", "potluck-test-again", uuid.uuid4().hex)
    writers.publish(spark, root, 1, {"t": spark.range(3), "gone": spark.range(1)})
    writers.begin(spark, root, 1)
    assert writers.list_versions(spark, root) == []
    writers.publish(spark, root, 1, {"t": spark.range(4)})
    assert writers.read_published(spark, root, "t").count() == 4
    assert writers.read_published(spark, root, "gone") is None


def test_empty_tables_are_not_published(spark):
    from potluck.sinks import writers
    root = shared_path(spark, "tests", "potluck-test-empty", uuid.uuid4().hex)
    writers.publish(spark, root, 1, {"full": spark.range(2), "empty": spark.range(0)}, skip_empty=("full", "empty"))
    assert writers.read_published(spark, root, "full").count() == 2
    assert writers.read_published(spark, root, "empty") is None


def test_export_report_tables_as_csv(spark, mini):
    from potluck.plans.export import export
    from potluck.sinks import writers
    root = shared_path(spark, "tests", "potluck-test-csv", uuid.uuid4().hex)
    export(spark, mini, root, version=1, report_format="csv")
    pp = writers.read_published(spark, root, "per_person_month", fmt="csv")
    assert pp.columns == ["group_id", "month", "person", "is_total", "amount"]
    assert pp.count() == 6
    assert writers.read_published(spark, root, "raw_expenses").count() == 4


def test_upsert_carries_no_names_or_zeros(spark, mini, monkeypatch):
    from potluck import queries
    from potluck.operators import upsert as operators
    seen = {}
    ranked = operators.ranked
    monkeypatch.setattr(queries, "from_tables", lambda *_: mini)
    monkeypatch.setattr(operators, "ranked", lambda df, *a: seen.update(rows=df) or ranked(df, *a))
    got = {r.expense_id: r.owes for r in queries.QUERIES["upsert_expenses"](spark, "/nowhere").collect()}
    assert got == {1: "Alice=60.0, Bob=40.0", -2: "Alice=1000.5, Bob=0.0", 2: None, 4: "Alice=80.0, Bob=0.0", 6: "Alice=0.0, Bob=0.0"}
    assert {r.expense_id: r.owes and [x.ord for x in r.owes] for r in seen["rows"].collect()} == {1: [0, 1], -2: [0], 2: None, 4: [0], 6: []}


@pytest.mark.parametrize("n", [5, 40])
def test_stored_owes_holds_what_is_not_zero(spark, n):
    """Few and many amounts: an earlier spelling of 0 or without a value hides a later one."""
    from potluck.operators.widen import stored_owes
    from potluck.schemas import MEMBERS
    members = spark.createDataFrame([(GID, i, f"m{i}", i) for i in range(n)], MEMBERS)
    columns = {f"m{i}_owed": float(i) for i in range(n)} | {f"m{i}_paid": 9.0 for i in range(n)} | {"m2_owes": None, "m3_owes": 0.0, "m4_owes": 7.005, "m9_x": 5.0}
    store = spark.createDataFrame([(GID, 1, columns)], "group_id long, expense_id long, member_columns map<string,double>")
    want = [0.0, 1.0, 0.0, 0.0, 7.01] + [float(i) for i in range(5, n)]
    assert [(x.ord, float(x.amount)) for x in stored_owes(store, members).first().owes] == [(i, v) for i, v in enumerate(want) if v]
    assert [(x.name, float(x.amount)) for x in canonical_owes(store, members).first().owes] == [(f"m{i}", v) for i, v in enumerate(want)]
