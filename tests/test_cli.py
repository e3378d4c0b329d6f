"""End-to-end command line runs over landed JSON documents."""

from __future__ import annotations

import json
import uuid

from ledger_rows import DEBTS, DOCS, GID, MEMBERS_JSON
from potluck.schemas import EXPENSE_DOC, EXPENSE_STORE
from potluck.session import shared_path


def _land(spark, base):
    spark.createDataFrame(DOCS, EXPENSE_DOC).write.json(f"{base}/docs")
    spark.createDataFrame([(GID, "Home", MEMBERS_JSON)], "group_id long, group_name string, members_json string") \
        .write.json(f"{base}/groups")
    spark.createDataFrame(DEBTS, "group_id long, `from` string, `to` string, amount string").write.json(f"{base}/debts")


def test_export_and_snapshot_commands(spark, capsys):
    from potluck.cli import main
    from potluck.sinks import writers
    base = shared_path(spark, "tests", "potluck-test-cli", uuid.uuid4().hex)
    _land(spark, base)
    args = ["--docs", f"{base}/docs", "--groups", f"{base}/groups", "--debts", f"{base}/debts"]
    assert main(["export", *args, "--out", f"{base}/export", "--version", "1", "--debug-shares"], spark) == 0
    out = capsys.readouterr()
    assert json.loads(out.out.strip().splitlines()[-1])["version"] == 1
    assert "more than one currency" in out.err
    raw = writers.read_published(spark, f"{base}/export", "raw_expenses", EXPENSE_STORE)
    assert sorted(r.expense_id for r in raw.collect()) == [1, 2, 4, 6]
    # month range and exclusions as flags
    assert main(["export", *args, "--out", f"{base}/export2", "--version", "1", "--start", "2024-03",
                 "--end", "2024-03", "--no-raw-shares"], spark) == 0
    raw2 = writers.read_published(spark, f"{base}/export2", "raw_expenses", EXPENSE_STORE)
    assert sorted(r.expense_id for r in raw2.collect()) == [4]
    assert writers.read_published(spark, f"{base}/export2", "raw_shares") is None
    assert main(["snapshot", *args, "--out", f"{base}/snap", "--version", "3"], spark) == 0
    doc = json.loads(writers.read_published(spark, f"{base}/snap", "snapshot").collect()[0].snapshot)
    assert doc["summary"]["expense_count"] == 4 and doc["months"][0] == "None"
    assert [b["name"] for b in doc["member_balances"]] == ["Alice", "Bob"]


def test_stream_command_once(spark):
    from potluck.cli import main
    from potluck.streaming.upsert_stream import current_dashboard, current_documents
    base = shared_path(spark, "tests", "potluck-test-cli-stream", uuid.uuid4().hex)
    _land(spark, base)
    assert main(["stream", "--landing", f"{base}/docs", "--store", f"{base}/store",
                 "--checkpoint", f"{base}/ckpt", "--format", "json", "--once", "--groups", f"{base}/groups",
                 "--debts", f"{base}/debts", "--recent", "5"], spark) == 0
    assert sorted(r.id for r in current_documents(spark, f"{base}/store").collect()) == [1, 2, 3, 4, 5, 6]
    doc = json.loads(current_dashboard(spark, f"{base}/store").collect()[0].snapshot)
    assert doc["summary"]["expense_count"] == 4 and doc["generated_at"] and len(doc["tables"]["recent_expenses"]["rows"]) == 4
