"""Parameterized dashboard views over many groups (validated filters, per group)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

G = "group_id"


def selected_category(expenses: DataFrame, category: str | None) -> DataFrame:
    """Per group the category to chart: the requested one if the group charts it, else the
    first charted category alphabetically. Charted = positive total over all months."""
    sel = (category or "").strip()
    totals = expenses.groupBy(G, "category").agg(F.sum("amount").alias("amount")).where(F.col("amount") > 0)
    choice = totals.groupBy(G).agg(F.min("category").alias("first"),
                                   F.max((F.col("category") == sel).cast("int")).alias("has"))
    return choice.select(G, F.when(F.col("has") == 1, F.lit(sel)).otherwise(F.col("first")).alias("category"))


def selected_month(expenses: DataFrame, month: str | None) -> DataFrame:
    """Per group the month filter: the requested month if the group has it, else ``all``."""
    from potluck.schemas import ALL_MONTHS
    sel = (month or ALL_MONTHS).strip()
    has = expenses.groupBy(G).agg(F.max((F.col("month") == sel).cast("int")).alias("has"))
    ok = (F.col("has") == 1) & F.lit(sel != ALL_MONTHS)
    return has.select(G, F.when(ok, F.lit(sel)).otherwise(F.lit(ALL_MONTHS)).alias("month"))


def dashboard_view(snapshot, category_month: str | None = None, person_month: str | None = None,
                   category: str | None = None) -> dict[str, DataFrame]:
    """The dashboard for chosen filters, per group: a header row plus the chart series.

    Returns ``header`` (one row per group: validated filters, scoped count/total, top
    debt, bar counts) and ``category_bars``, ``monthly_bars``, ``category_month_bars``,
    ``person_month_groups``.
    """
    from potluck.operators import aggregates as A
    from potluck.operators.bars import bars, person_month_groups
    from potluck.operators.debts import top_debt
    from potluck.schemas import ALL_MONTHS, CATEGORY_BARS_LIMIT, MONTH_BARS_LIMIT

    led = snapshot.ledger
    e = snapshot.sums
    cm = selected_month(e, category_month).withColumnRenamed("month", "selected_category_month")
    pm = selected_month(e, person_month).withColumnRenamed("month", "selected_person_month")
    cat = selected_category(e, category).withColumnRenamed("category", "selected_category")

    # Scoped count/total and category totals: conditional sums in one aggregation each,
    # validated per group at the aggregated level (no join of expense rows on the group).
    sel_cm = (category_month or ALL_MONTHS).strip()
    scoped = A.scoped_month(e, sel_cm).select(G, "scoped_count", "scoped_total")
    in_month = F.col("month") == sel_cm
    cat_all = e.groupBy(G, "category").agg(F.sum("amount").alias("all_amt"),
                                           F.sum(F.when(in_month, F.col("amount"))).alias("sel_amt"))
    cat_items = cat_all.join(cm, G).select(
        G, "category", F.when(F.col("selected_category_month") == ALL_MONTHS, F.col("all_amt"))
        .otherwise(F.col("sel_amt")).alias("amount"))
    category_bars = bars(cat_items, "category", [F.col("amount").desc(), F.col("category")],
                         CATEGORY_BARS_LIMIT, color=True)
    monthly = e.groupBy(G, "month").agg(F.sum("amount").alias("amount"))
    monthly_bars = bars(monthly, "month", [F.col("month").desc()], MONTH_BARS_LIMIT)
    series = (A.month_category_sums(e)
              .join(cat.withColumnRenamed("selected_category", "category"), [G, "category"], "left_semi")
              .select(G, "month", "amount"))
    category_month_bars = bars(series, "month", [F.col("month").desc()], MONTH_BARS_LIMIT)
    person = snapshot.person_month.drop("ord")
    person = person.join(pm, G).where((F.col("selected_person_month") == ALL_MONTHS)
                                      | (F.col("month") == F.col("selected_person_month")))
    groups = person_month_groups(person.drop("selected_person_month"), snapshot.months())
    top = top_debt(snapshot.debt_edges()).select(
        G, F.col("from_name").alias("top_debt_from"), F.col("to_name").alias("top_debt_to"),
        A.money("amount").alias("top_debt_amount"))

    def count_of(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(G).agg(F.count(F.lit(1)).alias(name))

    header = led.groups.select(G)
    for part in (cm, pm, cat, scoped, top, count_of(category_bars, "n_category_bars"),
                 count_of(monthly_bars, "n_monthly_bars"), count_of(category_month_bars, "n_category_month_bars"),
                 count_of(groups.select(G, "month").distinct(), "n_person_months")):
        header = header.join(part, G, "left")
    return {"header": header, "category_bars": category_bars, "monthly_bars": monthly_bars,
            "category_month_bars": category_month_bars, "person_month_groups": groups}


def tables_view(snapshot, month: str | None = None, query: str | None = None,
                table_limit: int | None = None) -> dict[str, DataFrame]:
    """Tables page: month + text filter on the expense, category and person tables;
    the row limit applies to the expense table only. ``header`` holds the counts.

    The month is selected once per group, from the months of its expenses, for all tables.
    """
    from potluck.operators.tables import in_selected_month, search, table_page
    from potluck.schemas import TABLE_LIMIT_DEFAULT, TABLE_LIMIT_MIN

    limit = max(int(table_limit or TABLE_LIMIT_DEFAULT), TABLE_LIMIT_MIN)
    raw = table_page(snapshot.raw_wide, month, query, limit)
    selected = selected_month(snapshot.sums, month)
    monthly = search(in_selected_month(snapshot.monthly_by_category(), selected), query)
    person = search(in_selected_month(snapshot.per_person_month(), selected), query)
    counts = raw.groupBy(G).agg(F.first("raw_total").alias("raw_total"), F.count(F.lit(1)).alias("raw_shown"))
    header = (snapshot.ledger.groups.select(G).join(selected.withColumnRenamed("month", "selected_month"), G, "left")
              .join(counts, G, "left")
              .select(G, "selected_month", F.lit((query or "").strip()).alias("query"),
                      F.coalesce("raw_total", F.lit(0)).alias("raw_total"),
                      F.coalesce("raw_shown", F.lit(0)).alias("raw_shown"),
                      F.lit(limit).alias("table_limit")))
    return {"header": header, "raw": raw, "monthly": monthly, "person": person}


def group_tables(snapshot, group_id: int) -> dict[str, DataFrame]:
    """The single-group tables exactly as the original shapes them, for one group.

    ``monthly_by_category``: month + that group's categories (sorted) + ``Total``, months
    ascending; ``per_person_month``: month + the group's members that have shares (member
    order) + ``Total``, newest month first; ``raw_expenses``: the display columns with a
    ``<name>_owes`` column for every member of the group, newest first. A table as wide as
    one group's own labels; labels equal to ``Total`` or to another column give way to it.
    """
    from potluck.operators.tables import raw_table
    from potluck.operators.widen import OWES
    from potluck.schemas import OWES_SUFFIX, RAW_TABLE_COLUMNS, TOTAL_LABEL

    one = F.col(G) == F.lit(group_id)

    def wide(rows: DataFrame, order) -> DataFrame:
        first = rows.select(F.transform("cells", lambda x: x["label"]).alias("l")).first()
        labels = [x for x in (first.l if first else []) if x not in ("month", TOTAL_LABEL)]
        amounts = F.map_from_entries(F.col("cells"))
        return rows.select("month", *[F.try_element_at(amounts, F.lit(x)).alias(x) for x in labels],
                           F.col("total").alias(TOTAL_LABEL)).orderBy(order)

    monthly = wide(snapshot.monthly_by_category().where(one), F.col("month"))
    person = wide(snapshot.per_person_month().where(one), F.col("month").desc())
    raw = raw_table(snapshot.raw_wide.where(one))
    row = snapshot.ledger.members.where(one).groupBy("name").agg(F.min("ord").alias("ord"))
    names = [r.name for r in row.orderBy("ord", "name").collect()]
    owes = F.map_from_entries(F.col(OWES))
    raw = raw.select(*[c for c in RAW_TABLE_COLUMNS if c in raw.columns],
                     *[F.try_element_at(owes, F.lit(n)).cast("double").alias(f"{n}{OWES_SUFFIX}") for n in names])
    return {"monthly_by_category": monthly, "per_person_month": person,
            "raw_expenses": raw.orderBy(F.col("date").desc(), "expense_id")}
