from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from ledger_rows import DEBTS, DOCS, GID, MEMBERS_JSON  # noqa: E402
from potluck.schemas import EXPENSE_DOC, GROUP_CONFIG  # noqa: E402

@pytest.fixture(scope="session")
def spark():
    from potluck.session import local_session
    s = local_session("*", shuffle_partitions=8, app="potluck-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(DOCS, EXPENSE_DOC)


@pytest.fixture(scope="session")
def mini(spark, docs):
    """Ledger over the hand-made documents (reverse direction, no exclusions)."""
    from potluck.operators.normalize import flatten_docs, normalize_expenses, normalize_shares
    from potluck.plans.ledger import build
    from potluck.sources.members import members_from_config
    groups = spark.createDataFrame([(GID, "Home", MEMBERS_JSON)], GROUP_CONFIG)
    members = members_from_config(groups)
    headers, share_rows = flatten_docs(docs)
    return build(groups, members, normalize_expenses(headers), normalize_shares(share_rows, members),
                 spark.createDataFrame(DEBTS, "group_id long, `from` string, `to` string, amount string"))
