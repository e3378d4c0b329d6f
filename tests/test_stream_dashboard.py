"""The dashboard of a refresh: brought forward by deltas, equal to a full rebuild."""

from __future__ import annotations

import random
import uuid

import pytest

from potluck.operators.exclusions import ExclusionRules
from potluck.operators.tables import first_rows
from potluck.plans.documents import document_values
from potluck.plans.ledger import LedgerParams
from potluck.plans.snapshot import Snapshot
from potluck.schemas import DEBTS_RAW, EXPENSE_DOC, GROUP_CONFIG
from potluck.session import shared_path
from potluck.sources.docs import ledger_from_docs
from potluck.streaming import dashboard as D
from potluck.streaming import upsert_stream as S

NAMES = {1: '{"10": "Ann", "11": "Ben"}', 2: '{"12": "Cy"}', 3: '{"10": "Dee"}'}


def _doc(rnd, i, group=None, stamp="1", deleted=None):
    date = f"2023-{rnd.randint(1, 12):02d}-{rnd.randint(10, 28)}"
    users = [{"user_id": str(rnd.randint(10, 13)), "user": None, "owed_share": f"{rnd.randint(1, 999) / 100:.2f}",
              "paid_share": f"{rnd.randint(0, 999) / 100:.2f}"} for _ in range(rnd.randint(0, 3))]
    return {"group_id": group or rnd.choice([1, 1, 1, 2, 3]), "id": i, "date": rnd.choice([date, date, date, None]), "updated_at": stamp,
            "deleted_at": deleted, "cost": f"{rnd.randint(1, 9999) / 100:.2f}", "currency_code": rnd.choice(["ILS", "USD"]),
            "description": rnd.choice(["rent", "food"]), "category": {"name": rnd.choice(["A", "B", "Payment"])}, "users": users}


@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.fixture
def sums_only(spark, monkeypatch):
    """Refreshes that do not render the documents, which ``test_published_documents`` covers."""
    class Nothing:
        to_json = monthly_by_category = per_person_month = lambda self: spark.range(1)
    monkeypatch.setattr(D, "_snapshot", lambda *_: Nothing())


class Refreshes:
    """Batches into a store, and the dashboard after each next to a rebuilt one."""

    def __init__(self, spark, recent=5, params=None):
        self.spark, self.store = spark, shared_path(spark, "tests", "dashboard", uuid.uuid4().hex) + "/store"
        self.names, self.batch, self.params = dict(NAMES), 0, params or LedgerParams()
        self.recent, self.debts = recent, [(1, "10", "11", "30")]

    def dashboard(self):
        return D.Dashboard(
            lambda spark: spark.createDataFrame([(g, f"group {g}", m) for g, m in self.names.items()], GROUP_CONFIG),
            lambda spark: spark.createDataFrame([(g, f, None, None, t, None, None, a) for g, f, t, a in self.debts], DEBTS_RAW),
            self.params, self.recent)

    def run(self, docs, batch=None):
        S.merge_batch(self.store, 50, self.dashboard())(
            self.spark.createDataFrame(docs, EXPENSE_DOC), self.batch if batch is None else batch)
        self.batch += batch is None

    def values(self):
        """The sums and the shown rows of the dashboard."""
        table = lambda name: S.current_dashboard(self.spark, self.store, name)
        recent = first_rows(table("recent").drop("pos", "cut"), self.dashboard().shown)
        return _values({**{name: table(name) for name in D.KEYS}, "recent": recent})

    def rebuilt(self):
        """The same from all documents of the store."""
        led = self.ledger()
        return _values({**D.contributions(led), "recent": first_rows(D._newest(led, self.dashboard().shown), self.dashboard().shown)})

    def ledger(self):
        d = self.dashboard()
        return ledger_from_docs(S.current_documents(self.spark, self.store), d.groups(self.spark), d.debts(self.spark), self.params)


def _values(tables):
    return {name: sorted((tuple(map(str, (r[c] for c in sorted(df.columns)))) for r in df.collect())) for name, df in tables.items()}


def test_deltas_equal_a_rebuild(spark, monkeypatch, sums_only):
    monkeypatch.setattr(D, "SPARE", 3)
    rnd = random.Random(5)
    r = Refreshes(spark)
    r.run([_doc(rnd, i) for i in range(1, 120)])
    # edits of amounts, months and categories, deletions, new documents, and a stale version
    r.run([_doc(rnd, i, stamp="2") for i in range(1, 40, 3)] + [_doc(rnd, i, stamp="2", deleted="x") for i in range(2, 60, 5)]
          + [_doc(rnd, i) for i in range(120, 140)] + [_doc(rnd, 7, stamp="0")])
    assert r.values() == r.rebuilt()
    # groups with another member map start anew; the next settings do so for all
    r.names = {1: '{"11": "Benny", "13": "Flo"}', 2: NAMES[2], 4: '{"10": "Gus"}'}
    r.run([_doc(rnd, 161, group=2)])
    assert r.values() == r.rebuilt()
    r.params = LedgerParams(debt_direction="normal", exclusions=ExclusionRules.of("2023-05", "rent"))
    r.run([_doc(rnd, 162, group=4)])
    assert r.values() == r.rebuilt()


def test_newest_rows_are_filled_up_when_too_few_are_left(spark, monkeypatch, sums_only):
    monkeypatch.setattr(D, "SPARE", 1)
    rnd = random.Random(6)
    r = Refreshes(spark)
    docs = [dict(_doc(rnd, i, group=1), date=f"2023-05-{10 + i // 3}", category=None) for i in range(1, 41)]
    r.run(docs)
    gone = [dict(d, updated_at="2", deleted_at="x") for d in docs if d["id"] >= 36]
    r.run(gone)
    shown = first_rows(S.current_dashboard(spark, r.store, "recent").drop("pos", "cut"), 5).orderBy("pos").collect()
    assert [x.expense_id for x in shown] == [33, 34, 35, 30, 31]
    assert r.values() == r.rebuilt()


def test_crash_between_the_commits_keeps_the_first(spark, monkeypatch, sums_only):
    rnd = random.Random(9)
    r = Refreshes(spark)
    r.run([_doc(rnd, i) for i in range(1, 130)])
    docs, shown = S.current_documents(spark, r.store).count(), r.values()
    change = [_doc(rnd, i, stamp="2") for i in range(55, 70)]

    def lost(spark, path, text="", touch=S.writers.touch):
        if path.endswith(S.POINTER):
            raise RuntimeError("lost")
        touch(spark, path, text)
    with monkeypatch.context() as m:
        m.setattr(S.writers, "touch", lost)
        with pytest.raises(RuntimeError):
            r.run(change)
    assert S.current_documents(spark, r.store).count() == docs and r.values() == shown
    read, documents = [], S._documents
    with monkeypatch.context() as m:
        m.setattr(S, "_documents", lambda spark, store, files: read.extend(x.id_range for x in files.collect())
                  or documents(spark, store, files))
        r.run(change, batch=1)                             # the batch runs again
    assert set(read) == {1}                                # and reads no documents of other ranges
    assert r.values() == r.rebuilt() != shown


def test_published_documents(spark):
    """Also where the batch before had no dashboard; the old batch is dropped afterwards."""
    rnd = random.Random(11)
    r = Refreshes(spark)
    S.merge_batch(r.store, 50)(spark.createDataFrame([_doc(rnd, i) for i in range(1, 60)], EXPENSE_DOC), 0)
    assert S.current_dashboard(spark, r.store) is None
    r.batch = 1
    r.run([_doc(rnd, i, stamp="2") for i in range(1, 40, 3)] + [_doc(rnd, 5, stamp="2", deleted="x")])
    assert S.drop_superseded(spark, r.store, keep=1) >= 2
    rows = lambda docs: sorted(map(tuple, document_values(docs).collect()), key=str)
    assert rows(S.current_dashboard(spark, r.store)) == rows(Snapshot(r.ledger(), r.recent).to_json())


def test_sums_of_documents_need_no_join_with_expenses(spark):
    """Settlements, deleted documents and those without an id are told apart by themselves."""
    rnd = random.Random(3)
    docs = [_doc(rnd, i, deleted=rnd.choice([None, None, "", "x"])) for i in range(1, 80)] + [dict(_doc(rnd, 1, group=1), id=None)] * 2
    r = Refreshes(spark)
    d, df = r.dashboard(), spark.createDataFrame(docs, EXPENSE_DOC)
    led = d.ledger(df, d.groups(spark))
    assert _values(D.contributions(led, df)) == _values(D.contributions(led))
    plan = D.contributions(led, df)["member_sums"]._jdf.queryExecution().optimizedPlan().toString()
    assert "expense_id" not in plan
