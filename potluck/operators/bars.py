"""Chart series: top-k bars with percent of the maximum, and per-month person groups.

Each series is per group and bounded (k bars, or months × members), so the windows
below partition by ``group_id`` over already-aggregated rows. Top-k uses ``row_number``
with a rank limit, which Spark turns into a partial per-task limit before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from potluck.functions.format import label_color
from potluck.functions.numbers import cents, pct_of_max
from potluck.operators.aggregates import money
from potluck.schemas import ALL_MONTHS, SUM, UNKNOWN_MONTH_RANK

G = "group_id"


def bars(items: DataFrame, label: str, order: list[Column], limit: int, color: bool = False,
         value: str = "amount") -> DataFrame:
    """Positive items, in ``order``, first ``limit`` (≤ 0: all), with percent of the max.

    Percent = round(amount / max * 100, 1) where the max is taken over the kept bars.
    ``items`` must hold exact decimal amounts in ``value``.
    """
    pos = F.row_number().over(Window.partitionBy(G).orderBy(*order))
    kept = items.where(F.col(value) > 0).select(G, F.col(label).alias("label"), F.col(value).alias("v"),
                                                pos.alias("pos"))
    if limit > 0:
        kept = kept.where(F.col("pos") <= limit)
    mx = F.max("v").over(Window.partitionBy(G))
    out = kept.select("*", mx.alias("mx")).select(
        G, (F.col("pos") - 1).cast("long").alias("pos"), "label", money("v").alias("amount"),
        pct_of_max(cents("v"), cents("mx")).alias("pct"))
    if color:
        out = out.withColumn("color", label_color("label"))
    return out


def person_month_groups(person_month: DataFrame, months: DataFrame, month_filter: str = ALL_MONTHS) -> DataFrame:
    """Grouped bars: for each month of the person table, every member's amount and percent.

    ``person_month`` is the long month × person table (exact ``amount``, ``is_total`` rows
    are ignored); ``months`` the group's known months (``group_id, month``). Months are
    ranked newest first, unknown months last; the max is over the shown cells, at least 1.
    """
    cells = person_month.where(~F.col("is_total"))
    if month_filter != ALL_MONTHS:
        cells = cells.where(F.col("month") == month_filter)
    ranked = months.select(G, "month", (F.dense_rank().over(
        Window.partitionBy(G).orderBy(F.col("month").desc())) - 1).alias("rank"))
    cells = cells.join(ranked, [G, "month"], "left")
    mx = F.greatest(F.max("amount").over(Window.partitionBy(G)), F.lit(1).cast(SUM))
    return cells.select(
        G, "month", F.coalesce("rank", F.lit(UNKNOWN_MONTH_RANK)).cast("long").alias("month_rank"),
        "person", money("amount").alias("amount"),
        pct_of_max(cents("amount"), cents(mx)).alias("pct"), label_color("person").alias("color"))
