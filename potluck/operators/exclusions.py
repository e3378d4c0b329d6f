"""Custom exclusion rules: drop expenses of given months whose description has given text."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from potluck.functions.text import contains_all_ci


@dataclass(frozen=True)
class ExclusionRules:
    """Months (``YYYY-MM``) and description texts; both must be given for the rules to act."""
    months: tuple[str, ...] = ()
    descriptions: tuple[str, ...] = ()

    @classmethod
    def of(cls, months: str = "", descriptions: str = "") -> "ExclusionRules":
        """Rules from comma lists; surrounding spaces, blank entries and repeats do not count."""
        return cls(*(tuple(dict.fromkeys(re.findall(r"[^,\s](?:[^,]*[^,\s])?", given)))
                     for given in (months, descriptions)))

    @property
    def active(self) -> bool:
        return bool(self.months and self.descriptions)


def drop_mask(rules: ExclusionRules):
    """Row is dropped when its month is listed AND its description holds *every* pattern."""
    return F.col("month").isin(list(rules.months)) & contains_all_ci(F.col("description"), list(rules.descriptions))


def _without_expenses(expenses: DataFrame, shares: DataFrame) -> DataFrame:
    """The few groups that have shares but no expense at all (one row per group)."""
    return shares.select("group_id").distinct().join(expenses.select("group_id").distinct(), "group_id", "left_anti")


def apply_exclusions(expenses: DataFrame, shares: DataFrame, rules: ExclusionRules) -> tuple[DataFrame, DataFrame]:
    """Filter expenses; when rules are active keep only shares of kept expenses.

    The share filter matches shares to the kept expense keys, so while rules are active
    the shares of settlement (and other non-kept) documents disappear as well. A group
    without any expense is left untouched (the original returns early on an empty expense
    table): those groups are found among the distinct ids of both tables, and only their
    shares are looked up by group.
    """
    if not rules.active:
        return expenses, shares
    kept = expenses.where(~F.coalesce(drop_mask(rules), F.lit(False)))
    of_kept = shares.join(kept.select("group_id", "expense_id"), ["group_id", "expense_id"], "left_semi")
    untouched = shares.join(_without_expenses(expenses, shares), "group_id", "left_semi")
    return kept, of_kept.unionByName(untouched)


def exclusion_counts(raw_expenses: DataFrame, raw_shares: DataFrame, rules: ExclusionRules) -> DataFrame:
    """Per group: expenses and shares before and after the rules.

    One aggregation per table: expenses count a drop flag; shares count the matches of a
    left join against the kept expense keys (the same rows the semi join keeps).
    """
    zero = F.lit(0).cast("long")
    if rules.active:
        dropped = F.coalesce(drop_mask(rules), F.lit(False))
        e = raw_expenses.groupBy("group_id").agg(
            F.count(F.lit(1)).alias("expenses_before"), F.count_if(~dropped).alias("expenses_after"))
        kept_ids = raw_expenses.where(~dropped).select("group_id", "expense_id", F.lit(1).alias("hit"))
        s = (raw_shares.select("group_id", "expense_id")
             .join(kept_ids, ["group_id", "expense_id"], "left")
             .groupBy("group_id").agg(F.count(F.lit(1)).alias("shares_before"), F.count("hit").alias("matched")))
    else:
        e = raw_expenses.groupBy("group_id").agg(F.count(F.lit(1)).alias("expenses_before"))
        e = e.withColumn("expenses_after", F.col("expenses_before"))
        s = raw_shares.groupBy("group_id").agg(F.count(F.lit(1)).alias("shares_before"))
        s = s.withColumn("matched", F.col("shares_before"))
    # a group without any expense keeps all its shares
    after = F.when(F.col("expenses_before").isNull(), F.col("shares_before")).otherwise(F.col("matched"))
    out = e.join(s, "group_id", "full").withColumn("shares_after", after)
    cols = ("expenses_before", "expenses_after", "shares_before", "shares_after")
    out = out.select("group_id", *[F.coalesce(F.col(c).cast("long"), zero).alias(c) for c in cols])
    return out.select("*", (F.col("expenses_before") - F.col("expenses_after")).alias("expenses_removed"),
                      (F.col("shares_before") - F.col("shares_after")).alias("shares_removed"))
