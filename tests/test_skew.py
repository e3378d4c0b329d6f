"""A hot group and a hot expense: results checked against a plain-Python brute force."""

from __future__ import annotations

import random
from collections import defaultdict
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from potluck.schemas import DEBTS_RAW, EXPENSE_DOC, GROUP_CONFIG

HOT, COLD = 1, 2


def _docs():
    rnd = random.Random(7)
    docs = []
    for i in range(1, 1201):
        g = HOT if i <= 1150 else COLD
        month = f"2023-{rnd.randint(1, 12):02d}"
        n_users = 300 if i == 17 else rnd.randint(1, 4)          # one expense with many shares
        users = [{"user_id": str(10 + (u % 6)), "user": {"id": str(10 + (u % 6)), "first_name": None},
                  "owed_share": f"{rnd.randint(1, 9999) / 100:.2f}", "paid_share": f"{rnd.randint(0, 9999) / 100:.2f}"}
                 for u in range(n_users)]
        docs.append({"group_id": g, "id": i, "date": f"{month}-{rnd.randint(10, 28)}", "updated_at": "x",
                     "deleted_at": None, "cost": f"{rnd.randint(100, 99999) / 100:.2f}", "currency_code": "ILS",
                     "description": rnd.choice(["rent", "food", "taxi"]), "category": {"name": rnd.choice(["A", "B"])},
                     "users": users})
    return docs


@pytest.fixture(scope="module")
def skewed(spark):
    from potluck.operators.normalize import flatten_docs, normalize_expenses, normalize_shares
    from potluck.plans.ledger import build
    from potluck.sources.members import members_from_config
    docs = _docs()
    groups = spark.createDataFrame([(HOT, "hot", '{"10": "Ann", "11": "Ben"}'), (COLD, "cold", '{"12": "Cy"}')],
                                   GROUP_CONFIG)
    members = members_from_config(groups)
    headers, rows = flatten_docs(spark.createDataFrame(docs, EXPENSE_DOC).repartition(6))
    led = build(groups, members, normalize_expenses(headers), normalize_shares(rows, members),
                spark.createDataFrame([], DEBTS_RAW))
    return docs, led


def test_month_category_and_person_month(skewed):
    from potluck.operators import aggregates as A
    docs, led = skewed
    want = defaultdict(Decimal)
    for d in docs:
        want[(d["group_id"], d["date"][:7], d["category"]["name"])] += Decimal(d["cost"])
    got = {(r.group_id, r.month, r.category): r.amount for r in A.month_category(led.expenses).collect()}
    assert got == {k: float(v) for k, v in want.items()}
    names = {(HOT, 10): "Ann", (HOT, 11): "Ben", (COLD, 12): "Cy"}
    owed = defaultdict(Decimal)
    for d in docs:
        for u in d["users"]:
            if (d["group_id"], int(u["user_id"])) in names:
                owed[(d["group_id"], d["date"][:7], names[(d["group_id"], int(u["user_id"]))])] += Decimal(u["owed_share"])
    got = {(r.group_id, r.month, r.person): r.amount
           for r in A.person_month_owed(led.shares, led.members).where("person <> 'Total'").collect()}
    assert {k: v for k, v in got.items() if v} == {k: float(v) for k, v in owed.items()}


def test_top_rows_and_page_of_a_hot_group(skewed):
    from potluck.operators.tables import first_rows, table_page
    from potluck.operators.widen import widen
    docs, led = skewed
    hot = sorted((d for d in docs if d["group_id"] == HOT), key=lambda d: (-int(d["date"].replace("-", "")), d["id"]))
    got = [r.expense_id for r in first_rows(led.expenses, 30).where(f"group_id = {HOT}").orderBy("pos").collect()]
    assert got == [d["id"] for d in hot[:30]]
    wide = widen(led.expenses, led.shares, led.members, F.col("owed_share"))
    page = table_page(wide, "2023-05", "taxi", 50).where(f"group_id = {HOT}")
    rows = page.orderBy("pos").collect()
    expect = [d for d in hot if d["date"].startswith("2023-05") and d["description"] == "taxi"]
    assert [r.expense_id for r in rows] == [d["id"] for d in expect[:50]]
    assert {r.raw_total for r in rows} == {len(expect)}


def test_hot_expense_widened(skewed):
    from potluck.operators.widen import widen
    docs, led = skewed
    d17 = next(d for d in docs if d["id"] == 17)
    want = sum(Decimal(u["owed_share"]) for u in d17["users"] if u["user_id"] == "10")
    wide = widen(led.expenses, led.shares, led.members, F.col("owed_share"))
    assert {x.name: x.amount for x in wide.where("expense_id = 17").collect()[0].owes}["Ann"] == want


def test_positions_of_a_hot_group_come_from_several_tasks(spark):
    """A group of nearly all rows is ranked in many ranges, next to groups of one row."""
    from potluck.operators import ranking
    rnd = random.Random(3)
    rows = [(HOT, rnd.randint(0, 50), i) for i in range(5000)] + [(g, 1, 1) for g in range(100, 140)] + [(None, 3, 3), (None, None, 1)]
    df = spark.createDataFrame(rows, "group_id long, a int, b long").repartition(5)
    parts = []

    def write(table, name):
        out = ranking.written(table, name)
        parts.append({r[0] for r in out.where(F.col("group_id") == HOT).select(ranking.PART).distinct().collect()})
        return out
    with_small = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ranking.ranked(df, ["group_id"], ["a", "b"], size="n", write=write).collect()
        every = ranking.ranked(df, [], ["a", "b", "group_id"]).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", with_small)
    assert len(parts[0]) > 4
    want, at = {}, defaultdict(int)
    for g, a, b in sorted(rows, key=lambda r: tuple((v is not None, v or 0) for v in r)):
        want[(g, a, b)] = at[g]
        at[g] += 1
    assert {(r.group_id, r.a, r.b): r.pos for r in got} == want and {(r.group_id, r.n) for r in got} == set(at.items())
    assert sorted(r.pos for r in every) == list(range(len(rows)))
    by_pos = [(r.a, r.b) for r in sorted(every, key=lambda r: r.pos)]
    assert by_pos == sorted(by_pos, key=lambda r: tuple((v is not None, v or 0) for v in r))


def test_wide_grid_takes_time_by_its_cells(spark):
    """2,000 columns: four times the columns of 500 take about four times as long, not sixteen."""
    import time

    from potluck.operators.aggregates import grid

    def cells(n, rows=12):
        sums = spark.range(n * rows).select(F.lit(HOT).alias("group_id"), (F.col("id") % rows).cast("string").alias("month"),
                                            F.concat(F.lit("c"), F.col("id").cast("string")).alias("category"), F.lit(1).cast("decimal(38,8)").alias("v"))
        t0 = time.perf_counter()
        out = grid(sums, "month", "category").agg(F.count("*"), F.sum("v")).first()
        return out, time.perf_counter() - t0
    cells(50)
    small, t_small = cells(125)
    large, t_large = cells(500)
    assert small == (125 * 12 * 12, 125 * 12) and large == (500 * 12 * 12, 500 * 12)
    assert t_large < 8 * t_small + 2


def test_member_columns_of_wide_rows(spark):
    """A member stored in every spelling, members without any, and columns of no member."""
    from potluck.operators.widen import canonical_owes
    from potluck.schemas import LEGACY_VARIANTS, MEMBERS
    names = ["Ann", "Ann_owed", "Zoe", "Bo"] + [f"m{i}" for i in range(300)]
    members = spark.createDataFrame([(HOT, i, n, i) for i, n in enumerate(names)], MEMBERS)
    columns = {"Zoe" + v: float(i) for i, v in enumerate(("_owes", *LEGACY_VARIANTS), 1)}
    columns |= {"Ann_owed_owed": 5.0, "Ann_paid": 6.005, "Bo_owes": None, "Bo_paid": 3.0, "Gone_owes": 9.0, "m7_paid_y": 2.0, "m7_owes_y": 1.0, "x": 4.0}
    store = spark.createDataFrame([(HOT, 1, columns), (HOT, 2, None), (COLD, 3, columns)], "group_id long, expense_id long, member_columns map<string,double>")
    got = {r.expense_id: {x.name: float(x.amount) for x in r.owes} for r in canonical_owes(store, members).collect()}
    assert list(got[1]) == names and got[2] == dict.fromkeys(names, 0.0) and got[3] == {}
    # "Ann_owed_owed" is Ann_owed's column; Ann has only the later spelling
    assert {n: a for n, a in got[1].items() if a} == {"Zoe": 1.0, "Ann_owed": 5.0, "Ann": 6.01, "m7": 2.0}
