"""Structured Streaming document store: stream = batch; replays, crashes, empty batches."""

from __future__ import annotations

import uuid

import pytest
from pyspark.sql import functions as F

from potluck.session import shared_path
from ledger_rows import rows
from potluck.operators.normalize import latest_documents
from potluck.sources.docs import ledger_from_docs
from potluck.streaming import upsert_stream as S

COLS = ["id", "description", "updated_at"]


def _base(spark, name):
    return shared_path(spark, "tests", f"potluck-test-{name}", uuid.uuid4().hex)


def _edit(docs, i, stamp, text, **more):
    out = docs.where(F.col("id") == i).withColumn("updated_at", F.lit(stamp)).withColumn("description", F.lit(text))
    for k, v in more.items():
        out = out.withColumn(k, F.lit(v))
    return out


def test_stream_equals_batch(spark, docs, mini):
    base = _base(spark, "stream")
    edit = _edit(docs, 1, "2030-01-01T00:00:00Z", "Market (edited)")
    for name, drop in (("a", docs.where("id <= 3")), ("b", docs.where("id > 3")), ("c", edit)):
        drop.coalesce(1).write.parquet(f"{base}/landing/{name}")
    S.start(spark, f"{base}/landing/*", f"{base}/store", f"{base}/ckpt", available_now=True,
            max_files_per_trigger=1, range_size=2).awaitTermination()
    store = S.current_documents(spark, f"{base}/store")
    assert rows(store, *COLS) == rows(latest_documents(docs.unionByName(edit)), *COLS)
    led = ledger_from_docs(store, mini.groups, mini.debts_raw)
    assert sorted(r.expense_id for r in led.expenses.collect()) == [1, 2, 4, 6]
    assert rows(led.shares, "expense_id", "user_id", "owed_share") == rows(mini.shares, "expense_id", "user_id", "owed_share")


def test_refresh_interval_floor():
    assert S.refresh_seconds(None) == 900
    assert S.refresh_seconds("5") == 30
    assert S.refresh_seconds(120) == 120


def test_empty_first_batch(spark, docs):
    base = _base(spark, "stream-empty")
    run = S.merge_batch(f"{base}/store", 2)
    assert S.current_documents(spark, f"{base}/store").count() == 0
    run(docs.limit(0), 0)
    assert S.current_documents(spark, f"{base}/store").count() == 0
    run(docs, 1)
    assert S.current_documents(spark, f"{base}/store").count() == 6


def test_crash_before_the_pointer_and_replay(spark, docs, monkeypatch):
    base = _base(spark, "stream-crash")
    store = f"{base}/store"
    run = S.merge_batch(store, 2)
    run(docs, 0)
    before = rows(S.current_documents(spark, store), *COLS)
    with monkeypatch.context() as m:
        m.setattr(S.writers, "touch", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            run(_edit(docs, 4, "2030-01-01T00:00:00Z", "Paris (edited)"), 1)
    assert rows(S.current_documents(spark, store), *COLS) == before       # the last good state
    for _ in range(2):                                                    # the batch runs again, twice
        run(_edit(docs, 4, "2030-01-01T00:00:00Z", "Paris (edited)"), 1)
        now = {r.id: r.description for r in S.current_documents(spark, store).collect()}
        assert now[4] == "Paris (edited)" and len(now) == 6


def test_batch_writes_only_its_ranges(spark, docs):
    base = _base(spark, "stream-parts")
    store = f"{base}/store"
    run = S.merge_batch(store, 2)
    run(docs, 0)
    run(_edit(docs, 4, "2030-01-01T00:00:00Z", "Paris (edited)"), 1)
    parts = {(r.id_range, r.version) for r in spark.read.parquet(f"{store}/data").select("id_range", "version").distinct().collect()}
    assert parts == {(0, 0), (1, 0), (2, 0), (3, 0), (2, 1)}
    run(_edit(docs, 4, "2031-01-01T00:00:00Z", "Paris (again)"), 2)
    plan = S._documents(spark, store, S.manifest(spark, store, 2).where("id_range = 2")).inputFiles()
    assert plan and all("/id_range=2/version=2/" in f for f in plan)          # nothing else is listed
    kept = {(r.id_range, r.version, r.rows, r.min_id, r.max_id) for r in S.manifest(spark, store, 2).collect()}
    assert kept == {(0, 0, 1, 1, 1), (1, 0, 2, 2, 3), (2, 2, 2, 4, 5), (3, 0, 1, 6, 6)}
    assert S.drop_superseded(spark, store, keep=2) == 2                       # a version of range 2, a manifest
    assert {r.id: r.description for r in S.current_documents(spark, store).collect()}[4] == "Paris (again)"


def test_deletion_hides_every_version_and_stale_ones_do_not_win(spark, docs, mini):
    base = _base(spark, "stream-delete")
    run = S.merge_batch(f"{base}/store", 1000)
    run(docs, 0)
    gone = _edit(docs, 1, "2030-01-01T00:00:00Z", "Market", deleted_at="2030-01-01")
    stale = docs.where("id = 2").withColumn("updated_at", F.lit(None).cast("string")).withColumn("description", F.lit("stale"))
    run(gone.unionByName(stale), 1)
    led = ledger_from_docs(S.current_documents(spark, f"{base}/store"), mini.groups, mini.debts_raw)
    assert {r.expense_id: r.description for r in led.expenses.collect()} == {2: "Fuel", 4: "Paris trip", 6: "Undated"}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_merge_shuffles_documents_once(spark, docs):
    files = spark.createDataFrame([(i, 2) for i in range(4)], "id_range long, files long")
    merged = S._merged(S._sliced(docs.where("id <= 3"), docs.where("id >= 3"), files, 2))
    assert _plan(merged).count("Exchange hashpartitioning") == 2        # of those with an id, and of those without


def test_slices_hold_every_document(spark, docs, monkeypatch):
    monkeypatch.setattr(S, "DOCS_PER_FILE", 1)
    store = f"{_base(spark, 'stream-slices')}/store"
    nameless = docs.where("id <= 2").withColumn("id", F.lit(None).cast("long"))
    both = docs.unionByName(nameless).unionByName(nameless)                 # without an id all are kept
    S.merge_batch(store, 1000)(both, 0)
    S.merge_batch(store, 1000)(_edit(docs, 4, "2030-01-01T00:00:00Z", "Paris (edited)").unionByName(nameless), 1)
    now = S.current_documents(spark, store)
    assert len({f.rsplit("/", 1)[1] for f in now.where("id > 0").inputFiles()}) > 1
    assert rows(now, *COLS) == rows(latest_documents(
        both.unionByName(nameless).unionByName(_edit(docs, 4, "2030-01-01T00:00:00Z", "Paris (edited)"))), *COLS)


def test_touched_documents_have_the_stored_one_beside_them(spark, docs):
    files = spark.createDataFrame([(0, 3)], "id_range long, files long")
    stale = _edit(docs, 2, None, "stale")
    got = S._merged(S._sliced(docs, _edit(docs, 1, "2030-01-01T00:00:00Z", "new").unionByName(stale).unionByName(
        docs.where("id = 3").withColumn("id", F.lit(7).cast("long"))), files, 1000))
    old = {r.id: r.description for r in docs.collect()}
    assert {r.id: (r.description, r.touched, r.before and r.before.description) for r in got.collect()} == {
        **{i: (old[i], False, None) for i in (3, 4, 5, 6)}, 1: ("new", True, old[1]), 2: (old[2], True, old[2]), 7: (old[3], True, None)}


def test_store_is_read_without_a_shuffle_and_keeps_its_ranges(spark, docs, mini):
    store = f"{_base(spark, 'stream-read')}/store"
    S.merge_batch(store, 2)(docs, 0)
    led = ledger_from_docs(S.current_documents(spark, store), mini.groups, mini.debts_raw, latest=True)
    assert "Exchange" not in _plan(led.expenses)
    assert rows(led.expenses, "expense_id", "amount") == rows(mini.expenses, "expense_id", "amount")
    with pytest.raises(ValueError, match="ranges"):
        S.merge_batch(store, 3)(docs, 1)
