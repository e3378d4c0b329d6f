"""Month calendars and half-open month bounds.

Bounds are constant Spark expressions, which fold into plain filter values and reach the
scan; the per-group calendars are DataFrames computed from the ledger itself.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


_MONTH = re.compile(r"[0-9]{4}-(0[1-9]|1[0-2])")


def month_start(ym: str, months_later: int = 0) -> Column:
    """The first day of ``YYYY-MM``, or of a month some months later, as a date."""
    if not _MONTH.fullmatch(ym):
        raise ValueError(f"not a month (YYYY-MM): {ym!r}")
    return F.add_months(F.to_date(F.lit(f"{ym}-01")), months_later)


def in_months(date: Column, start_ym: str | None, end_ym: str | None) -> Column:
    """Is ``date`` (a date, a timestamp, or ISO text) in the whole months from start to end?

    A missing bound is open; an end before the start is an error."""
    if start_ym and end_ym and end_ym < start_ym:
        raise ValueError(f"the end {end_ym} is before the start {start_ym}")
    inside = F.lit(True)
    if start_ym:
        inside = inside & (date >= month_start(start_ym))
    if end_ym:
        inside = inside & (date < month_start(end_ym, 1))
    return inside


def group_calendar(expenses: DataFrame) -> DataFrame:
    """Per group, every calendar month from its first to its last dated expense.

    ``group_id, month``; the sequence is generated per group (no join), one row per month.
    """
    dated = expenses.where(F.col("month").rlike(r"^[0-9]{4}-[0-9]{2}$"))
    span = dated.groupBy("group_id").agg(F.min("month").alias("lo"), F.max("month").alias("hi"))
    first = F.to_date(F.concat(F.col("lo"), F.lit("-01")))
    last = F.to_date(F.concat(F.col("hi"), F.lit("-01")))
    months = F.sequence(first, last, F.expr("INTERVAL 1 MONTH"))
    return span.select("group_id", F.explode(months).alias("d")).select(
        "group_id", F.date_format("d", "yyyy-MM").alias("month"))


def calendar_bounds(calendar: DataFrame) -> DataFrame:
    """``group_id, month`` → plus ``start_date`` (inclusive) and ``end_date`` (exclusive)."""
    d = F.to_date(F.concat(F.col("month"), F.lit("-01")))
    return calendar.select("group_id", "month",
                           F.date_format(F.trunc(d, "MM"), "yyyy-MM-dd").alias("start_date"),
                           F.date_format(F.add_months(F.trunc(d, "MM"), 1), "yyyy-MM-dd").alias("end_date"))
