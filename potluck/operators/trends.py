"""Month-over-month change per category (and the month ``Total``) on a zero-filled grid.

The original computes differences on its month × category pivot, where a category absent
in a month counts as 0 and only months that have rows appear (no calendar gap filling).
Here the grid is the present months × present categories *of each group*; it is bounded
by calendar × category taxonomy, not by the number of expenses. The window runs per
(group, category), never over one global partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from potluck.operators.aggregates import grid, money
from potluck.schemas import TOTAL_LABEL

G = "group_id"


def mom_full(expenses: DataFrame) -> DataFrame:
    """``group_id, month, category, is_total, value, delta, pct`` (delta null / pct 0 on the
    first month); a month's total is the row with ``is_total``.

    ``pct`` = value / previous − 1 in double; a previous value of 0 (or none) gives 0.0.
    """
    sums = expenses.groupBy(G, "month", "category").agg(F.sum("amount").alias("v"))
    cells = grid(sums, "month", "category", total_label=TOTAL_LABEL)
    w = Window.partitionBy(G, "category", "is_total").orderBy("month")
    prev = F.lag("v").over(w)
    lagged = cells.select("*", prev.alias("prev"))
    ratio = F.col("v").cast("double") / F.col("prev").cast("double") - F.lit(1.0)
    pct = F.when(F.col("prev").isNull() | (F.col("prev") == 0), F.lit(0.0)).otherwise(ratio)
    return lagged.select(G, "month", "category", "is_total", money("v").alias("value"),
                         money(F.col("v") - F.col("prev")).alias("delta"), pct.alias("pct"))


def mom_delta(expenses: DataFrame) -> DataFrame:
    return mom_full(expenses).select(G, "month", "category", "is_total", "delta")


def mom_pct(expenses: DataFrame) -> DataFrame:
    return mom_full(expenses).select(G, "month", "category", "is_total", "pct")
