"""Aggregations of the ledger: month × category, month × person, totals, summaries.

All sums run on exact decimal cents with partial (map-side) aggregation; money leaves as
double at the very end. Every table is keyed by ``group_id`` so that one job serves any
number of groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from potluck.functions.text import nonblank
from potluck.schemas import ALL_MONTHS, ALL_MONTHS_LABEL, MONEY, SUM, TOTAL_LABEL

G = "group_id"


def money(c) -> Column:
    """Exact decimal → double for output (nothing is rounded here)."""
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def net_owes(mode: str) -> Column:
    """Net amount a share row still owes, clipped at 0 per row (``reverse`` flips the sign)."""
    paid, owed = F.col("paid_share"), F.col("owed_share")
    diff = paid - owed if mode == "reverse" else owed - paid
    return F.greatest(diff, F.lit(0).cast(MONEY))


def grid(sums: DataFrame, row: str, col: str, value: str = "v", cols: DataFrame | None = None,
         total_label: str | None = None) -> DataFrame:
    """Zero-filled pivot cells of each group: its rows × its columns, one row per cell, with
    the ``total`` of the row beside it.

    ``sums`` holds ``group_id, row, col, value``, at most one row per cell; a null ``col``
    marks a row of the grid without cells. ``cols`` (``group_id, col``) replaces the columns
    that occur; else ``total_label`` adds the totals as one more column, marked by ``is_total``.
    Each row of the pivot is gathered into an array, as long as the pivot is wide, and each
    group's columns into one list. A row's cells and a zero for each column are sorted together
    and the first of each column is kept: the work is in proportion to the cells, nothing is
    looked up. The columns come from the same arrays, so Spark reuses their shuffle and runs
    the input once; no task holds a group's whole grid.
    """
    cell = F.when(F.col(col).isNotNull(), F.struct(F.col(col).alias("k"), F.lit(0).alias("rank"), F.col(value).cast(SUM).alias("v")))
    zero = F.lit(0).cast(SUM)
    rows = sums.groupBy(G, row).agg(
        F.collect_list(cell).alias("_cells"),
        F.coalesce(F.sum(F.when(F.col(col).isNotNull(), F.col(value))).cast(SUM), zero).alias("total"))
    names = rows.select(G, F.explode("_cells.k").alias(col)) if cols is None else cols.select(G, col)
    lists = names.distinct().groupBy(G).agg(F.collect_list(col).alias("_names"))
    empty = F.transform(F.coalesce("_names", F.array().cast("array<string>")),
                        lambda n: F.struct(n.alias("k"), F.lit(1).alias("rank"), zero.alias("v")))
    both = rows.join(lists, G, "left").select(G, row, "total", F.array_sort(F.concat("_cells", empty)).alias("_all"))
    beside = lambda x, i: F.get("_all", i)["k"].eqNullSafe(x["k"])
    kept = F.filter("_all", lambda x, i: ~beside(x, i - 1) & ((x["rank"] == 1) | beside(x, i + 1)))
    cells = F.transform(kept, lambda x: F.struct(x["k"].alias(col), F.lit(False).alias("is_total"), x["v"].alias(value)))
    if cols is None and total_label is not None:
        cells = F.concat(cells, F.array(F.struct(F.lit(total_label).alias(col), F.lit(True).alias("is_total"),
                                                 F.col("total").alias(value))))
    return both.select(G, row, F.explode(cells).alias("_c"), "total").select(G, row, "_c.*", "total")


# ---------------------------------------------------------------- expense aggregates

# The chart base: sums of expenses with the number of expenses behind each, in ``n``. It has
# the columns that the functions below read, so they take it in the place of the expenses.
CHART_KEY = ("month", "category", "currency")


def chart_base(expenses: DataFrame) -> DataFrame:
    return expenses.groupBy(G, *CHART_KEY).agg(F.sum("amount").cast(SUM).alias("amount"), F.count("*").alias("n"))


def _rows(expenses: DataFrame, condition: Column | None = None) -> Column:
    """The number of expenses, or of those for which a condition holds."""
    each = F.col("n") if "n" in expenses.columns else F.lit(1)
    return F.coalesce(F.sum(each if condition is None else F.when(condition, each)), F.lit(0))


def month_category_sums(expenses: DataFrame) -> DataFrame:
    """``group_id, month, category, amount`` (decimal) — the basis of most charts."""
    return expenses.groupBy(G, "month", "category").agg(F.sum("amount").alias("amount"))


def month_category(expenses: DataFrame) -> DataFrame:
    """Month × category totals in long form (one row per present cell)."""
    return month_category_sums(expenses).select(G, "month", "category", money("amount").alias("amount"))


def month_category_grid(expenses: DataFrame) -> DataFrame:
    """Month × category table of each group, zero-filled, one row per cell, with the month's
    total beside every cell (``total`` is a column, so no category's name can clash with it).

    The categories are the group's own. One group's table in the wide form, one column per
    category, is ``plans.views.group_tables``.
    """
    sums = month_category_sums(expenses).withColumnRenamed("amount", "v")
    return grid(sums, "month", "category").select(
        G, "month", "category", money("v").alias("amount"), money("total").alias("total"))


def monthly_totals(expenses: DataFrame) -> DataFrame:
    return expenses.groupBy(G, "month").agg(money(F.sum("amount")).alias("amount"))


def category_totals(expenses: DataFrame) -> DataFrame:
    """Totals per category over all months; only positive totals (chart series)."""
    s = expenses.groupBy(G, "category").agg(F.sum("amount").alias("amount"))
    return s.where(F.col("amount") > 0).select(G, "category", money("amount").alias("amount"))


def category_by_month(expenses: DataFrame) -> DataFrame:
    """Totals per category within each month; only positive totals."""
    s = month_category_sums(expenses)
    return s.where(F.col("amount") > 0).select(G, "month", "category", money("amount").alias("amount"))


def category_cube(expenses: DataFrame) -> DataFrame:
    """All-months and per-month category totals in one aggregation (grouping sets).

    Rows of the all-months set carry the month label ``All months``.
    """
    cube = expenses.groupingSets([[G, "category"], [G, "month", "category"]], G, "month", "category").agg(
        F.sum("amount").alias("amount"), F.grouping("month").alias("all_months"))
    label = F.when(F.col("all_months") == 1, F.lit(ALL_MONTHS_LABEL)).otherwise(F.col("month"))
    return cube.select(G, label.alias("month"), "category", money("amount").alias("amount"))


def category_series(expenses: DataFrame, category: str | None = None) -> DataFrame:
    """Per category: its months (newest first) with positive totals; ``pos`` is the order.

    With ``category`` given, only that series (the dashboard's selected category).
    """
    s = month_category_sums(expenses)
    if category is not None:
        s = s.where(F.col("category") == category)
    s = s.where(F.col("amount") > 0)
    from pyspark.sql import Window
    w = Window.partitionBy(G, "category").orderBy(F.col("month").desc())
    return s.select(G, "category", "month", money("amount").alias("amount"),
                    (F.row_number().over(w) - 1).alias("pos"))


def summary(expenses: DataFrame) -> DataFrame:
    """Per group: expense count, grand total, sorted distinct currencies (comma list)."""
    cur = F.when(nonblank("currency"), F.col("currency"))
    return expenses.groupBy(G).agg(
        _rows(expenses).alias("expense_count"),
        money(F.sum("amount")).alias("total_expenses"),
        F.array_join(F.array_sort(F.collect_set(cur)), ",").alias("currencies"),
    )


def multi_currency(expenses: DataFrame) -> DataFrame:
    """Per group: number of distinct currencies and the warning flag (> 1)."""
    n = F.count_distinct("currency")
    return expenses.groupBy(G).agg(n.alias("currency_count"), (n > 1).alias("multi_currency"))


def distinct_values(expenses: DataFrame) -> DataFrame:
    """``group_id, kind, value``: currencies, months (non-blank) and charted categories.

    Expenses are summed per combination of the three first; only those sums are taken
    apart into (kind, value) pairs. Categories are kept only with a positive total.
    """
    kinds = ("currency", "month", "category")
    sums = expenses.groupBy(G, *kinds).agg(F.sum("amount").alias("amount"))
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value"), F.col("amount").alias("amount"))
                      for k in kinds])
    s = (sums.select(G, F.explode(pairs).alias("p")).select(G, "p.*")
         .groupBy(G, "kind", "value").agg(F.sum("amount").alias("amount")))
    keep = F.when(F.col("kind") == "category", F.col("amount") > 0).otherwise(nonblank("value"))
    return s.where(keep).select(G, "kind", "value")


def scoped_month(expenses: DataFrame, month: str | None) -> DataFrame:
    """Count and total of one month per group; a month unknown to the group means all.

    Validation and both answers come from one conditional aggregation per group, so no
    month list travels to the driver.
    """
    sel = (month or ALL_MONTHS).strip()
    per_group = expenses.groupBy(G).agg(
        _rows(expenses).alias("all_count"), F.sum("amount").alias("all_total"),
        _rows(expenses, F.col("month") == sel).alias("m_count"),
        F.sum(F.when(F.col("month") == sel, F.col("amount"))).alias("m_total"))
    valid = (F.col("m_count") > 0) & F.lit(sel != ALL_MONTHS)
    zero = F.lit(0).cast(SUM)
    return per_group.select(
        G,
        F.when(valid, F.lit(sel)).otherwise(F.lit(ALL_MONTHS)).alias("selected_month"),
        F.when(valid, F.col("m_count")).otherwise(F.col("all_count")).alias("scoped_count"),
        money(F.when(valid, F.coalesce(F.col("m_total"), zero)).otherwise(F.col("all_total"))).alias("scoped_total"),
    )


# ---------------------------------------------------------------- share aggregates

def member_order(members: DataFrame) -> DataFrame:
    """``group_id, name, ord``: each member name of a group once, with its first position."""
    return members.groupBy(G, "name").agg(F.min("ord").alias("ord"))


def tracked_shares(shares: DataFrame, members: DataFrame) -> DataFrame:
    """Shares of configured members, named by the member map (inner join = semi + lookup)."""
    m = members.select(G, "user_id", F.col("name").alias("member"), "ord")
    return shares.join(m, [G, "user_id"], "inner")


def person_month(shares: DataFrame, members: DataFrame, value: Column) -> DataFrame:
    """Month × person grid of a share value (zero-filled), plus one ``is_total`` row per month.

    Months are those with tracked shares; persons are the members present in the group's
    rows (members without any share are omitted, as in the wide original). ``amount`` is
    exact; ``ord`` is the member order, totals last.
    """
    t = tracked_shares(shares, members).select(G, "month", "member", value.alias("v"))
    return person_month_grid(t.groupBy(G, "month", "member").agg(F.sum("v").alias("v")), members)


def person_month_grid(sums: DataFrame, members: DataFrame) -> DataFrame:
    """``person_month`` from its sums (``month, member, v``)."""
    order = member_order(members).withColumnRenamed("name", "member")
    cells = grid(sums, "month", "member", total_label=TOTAL_LABEL).join(
        order.withColumn("is_total", F.lit(False)), [G, "member", "is_total"], "left")
    return cells.select(G, "month", F.col("member").alias("person"), "is_total",
                        F.coalesce("ord", F.lit(2**31 - 1)).alias("ord"), F.col("v").alias("amount"))


def member_base(expenses: DataFrame, shares: DataFrame, members: DataFrame, mode: str) -> DataFrame:
    """The base of the person charts: net owes per month and member with the number of share
    rows behind each, apart for shares of kept expenses (``kept``) and of settlements."""
    t = tracked_shares(shares, members).select(G, "expense_id", "month", "member", "owed_share", "paid_share")
    keys = expenses.select(G, "expense_id", F.lit(True).alias("kept"))
    return _member_sums(t.join(keys, [G, "expense_id"], "left"), mode)


def marked_member_base(shares: DataFrame, members: DataFrame, mode: str) -> DataFrame:
    """``member_base`` of shares that know whether they are ``kept`` (``docs.marked_shares``)."""
    return _member_sums(tracked_shares(shares, members), mode)


def _member_sums(shares: DataFrame, mode: str) -> DataFrame:
    t = shares.select(G, "month", "member", F.coalesce("kept", F.lit(False)).alias("kept"), net_owes(mode).alias("v"))
    return t.groupBy(G, "month", "member", "kept").agg(F.sum("v").cast(SUM).alias("v"), F.count("*").alias("n"))


def person_month_owed(shares: DataFrame, members: DataFrame) -> DataFrame:
    """Export table: owed share per month and member (+ the month's total)."""
    return person_month(shares, members, F.col("owed_share")).drop("ord").withColumn("amount", money("amount"))


def person_month_net(shares: DataFrame, members: DataFrame, mode: str) -> DataFrame:
    """Dashboard table: clipped net owes per month and member (+ the month's total)."""
    return person_month(shares, members, net_owes(mode)).drop("ord").withColumn("amount", money("amount"))


def share_sanity(shares: DataFrame) -> DataFrame:
    """Per group: share rows and distinct expenses among them."""
    return shares.groupBy(G).agg(F.count(F.lit(1)).alias("share_rows"),
                                 F.count_distinct("expense_id").alias("distinct_expenses"))


def share_sample(shares: DataFrame, n: int = 6) -> DataFrame:
    """First ``n`` share rows per group in key order: a bounded peek (per-task group limit)."""
    from pyspark.sql import Window
    w = Window.partitionBy(G).orderBy("expense_id", "user_id", "owed_share", "paid_share")
    return shares.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def kept_expense_shares(shares: DataFrame, expenses: DataFrame) -> DataFrame:
    """Shares whose expense survives in the expense table (settlements excluded)."""
    return shares.join(expenses.select(G, "expense_id"), [G, "expense_id"], "left_semi")


def person_totals(expenses: DataFrame, shares: DataFrame, members: DataFrame, mode: str) -> DataFrame:
    """Net owes per member over all kept expenses; every member listed (0 when none)."""
    t = tracked_shares(kept_expense_shares(shares, expenses), members)
    sums = t.groupBy(G, "member").agg(F.sum(net_owes(mode)).alias("v"))
    names = member_order(members).withColumnRenamed("name", "member")
    zero = F.lit(0).cast(SUM)
    return names.join(sums, [G, "member"], "left").select(
        G, F.col("member").alias("person"), money(F.coalesce("v", zero)).alias("amount"))


def person_totals_by_month(expenses: DataFrame, shares: DataFrame, members: DataFrame, mode: str) -> DataFrame:
    """Net owes per month (of the expense table) and member; zero-filled grid.

    The expense table is consumed once: its rows are left-joined with the tracked share
    rows on the full key (settlement shares find no expense and drop out), so months
    without any tracked share still appear. All members of the group are columns.
    """
    t = tracked_shares(shares, members).select(G, "expense_id", "member", net_owes(mode).alias("v"))
    rows = expenses.select(G, "expense_id", "month").join(t, [G, "expense_id"], "left")
    sums = rows.groupBy(G, "month", "member").agg(F.sum("v").cast(SUM).alias("v"))
    return person_totals_grid(sums, members)


def person_totals_grid(sums: DataFrame, members: DataFrame) -> DataFrame:
    """``person_totals_by_month`` from its sums (``month, member, v``; a null member stands for
    a month alone)."""
    names = member_order(members).select(G, F.col("name").alias("member"))
    return grid(sums, "month", "member", cols=names).select(
        G, "month", F.col("member").alias("person"), money("v").alias("amount"))


def top_people(shares: DataFrame, members: DataFrame, k: int = 2) -> DataFrame:
    """Top-``k`` members by total owed share; ties go to the later member column."""
    from pyspark.sql import Window
    t = tracked_shares(shares, members)
    tot = t.groupBy(G, "member").agg(F.sum("owed_share").alias("v"), F.min("ord").alias("ord"))
    w = Window.partitionBy(G).orderBy(F.col("v").desc(), F.col("ord").desc())
    ranked = tot.select("*", F.row_number().over(w).alias("rank")).where(F.col("rank") <= k)
    return ranked.select(G, F.col("rank").cast("long").alias("rank"), F.col("member").alias("person"),
                         money("v").alias("amount"))
