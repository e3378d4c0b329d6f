"""Plan checks: no Python UDFs, pushed-down date bounds, broadcast dimension joins."""

from __future__ import annotations

import pytest

from potluck.queries import QUERIES

SF = "/root/testdata/sf0.001"
SIDE_EFFECT = {"sink_roundtrip", "sink_shares", "stream_upsert", "stream_shares", "snapshot_json", "dashboard_view", "tables_view"}


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SIDE_EFFECT))
def test_no_python_udf(spark, name):
    text = plan_text(QUERIES[name](spark, SF))
    assert "PythonUDF" not in text and "BatchEvalPython" not in text and "ArrowEvalPython" not in text


def test_month_range_reaches_the_scan(spark):
    text = plan_text(QUERIES["scan_month_range"](spark, SF))
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in text or (
        "GreaterThanOrEqual(o_orderdate" in text and "LessThan(o_orderdate" in text)


def test_scan_prunes_columns(spark):
    text = plan_text(QUERIES["month_category"](spark, SF))
    assert "o_orderstatus" not in text  # never read


def test_member_lookup_is_broadcast(spark):
    text = plan_text(QUERIES["explode_shares"](spark, SF))
    assert "BroadcastHashJoin" in text


def test_top_k_uses_group_limit(spark):
    text = plan_text(QUERIES["recent_expenses"](spark, SF))
    assert "WindowGroupLimit" in text


@pytest.mark.parametrize("name", ["summary", "multi_currency", "scoped_month", "share_sanity", "distinct_values"])
def test_group_keyed_aggregates_combine_before_the_shuffle(spark, name):
    # a hot group sends one partial row per task, not its rows
    text = plan_text(QUERIES[name](spark, SF))
    assert "partial_" in text


def subtree(text: str, node: str) -> list[str]:
    """The lines below each occurrence of a plan node."""
    lines, out = text.splitlines(), []
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    for i, line in enumerate(lines):
        if line.lstrip(" :+-").startswith(node):
            for below in lines[i + 1:]:
                if depth(below) <= depth(line):
                    break
                out.append(below)
    return out


def test_no_fact_table_broadcast(spark):
    text = plan_text(QUERIES["widen_net_owes"](spark, SF))
    assert "BroadcastExchange" in text
    assert not [line for line in subtree(text, "BroadcastExchange") if "lineitem" in line]


@pytest.mark.parametrize("name,most", [("exclusions", 2), ("exclusion_counts", 3), ("table_page", 2), ("upsert_expenses", 3),
                                       ("mom_full", 1), ("month_category_pivot", 1), ("distinct_values", 1)])
def test_scans_of_the_expense_table(spark, name, most):
    # a shuffle that is used again counts once: only what is left in the plan is scanned
    df = QUERIES[name](spark, SF)
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    final = text.split("== Initial Plan ==")[0]
    assert final.count("orders.parquet") <= most, final.count("orders.parquet")


def test_landed_documents_month_range_is_pushed_down(spark, docs):
    import uuid
    from potluck.session import shared_path
    from potluck.sources.docs import month_range, read_docs
    path = shared_path(spark, "tests", "potluck-test-docs", uuid.uuid4().hex)
    docs.write.parquet(path)
    df = month_range(read_docs(spark, path, "parquet"), "2024-03", "2024-03")
    text = plan_text(df)
    assert "GreaterThanOrEqual(date,2024-03-01)" in text and "LessThan(date,2024-04-01)" in text
    assert sorted(r.id for r in df.collect()) == [4, 5]


def test_members_are_not_looked_up_in_each_expense(spark):
    assert "try_element_at" not in plan_text(QUERIES["widen_owes"](spark, SF))


def test_a_drop_is_made_of_one_pass_over_the_tables(spark):
    from potluck.sources import fixture
    for drop in fixture.landed_documents(spark, SF):
        assert drop._jdf.queryExecution().optimizedPlan().toString().count("l_extendedprice") > 0
        assert drop._jdf.queryExecution().executedPlan().toString().count("/lineitem.parquet") == 1
