"""Simplified-debt graph: directed edges, member balances, debtor totals, top edge.

Edges of one group are few (at most members × members), so every operator here is a
small aggregation keyed by ``group_id``; member names come from a join with the member
dimension, which the planner broadcasts when its size allows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from potluck.functions.numbers import lenient_long, lenient_money, resolve_user_id
from potluck.operators.aggregates import money
from potluck.operators.normalize import first_present
from potluck.schemas import MONEY, SUM, UNKNOWN_PERSON

G = "group_id"
FROM_FIELDS = ["from", "from_user", "from_user_id"]
TO_FIELDS = ["to", "to_user", "to_user_id"]


def _name_lookup(members: DataFrame, id_col: str, name_col: str) -> DataFrame:
    return members.select(G, F.col("user_id").alias(id_col), F.col("name").alias(name_col))


def _display_name(name_col: str, id_col: str):
    return F.coalesce(F.col(name_col), F.col(id_col).cast("string"), F.lit(UNKNOWN_PERSON))


def debt_edges(debts_raw: DataFrame, members: DataFrame, mode: str) -> DataFrame:
    """Edges ``from → to`` with names and positive amounts rounded to cents.

    ``reverse`` (the default mode) swaps the landed direction. Endpoints are resolved
    leniently (ids, digit text or ``{"id": ..}`` objects); unknown ids keep their number
    as the name, missing ones become ``Unknown``. ``pos`` numbers a group's edges by amount,
    largest first (ties: lower ids).
    """
    f_raw = first_present(debts_raw, FROM_FIELDS, truthy=True)
    t_raw = first_present(debts_raw, TO_FIELDS, truthy=True)
    src, dst = (t_raw, f_raw) if mode == "reverse" else (f_raw, t_raw)
    edges = debts_raw.select(
        G, resolve_user_id(src).alias("from_id"), resolve_user_id(dst).alias("to_id"),
        F.round(lenient_money(F.col("amount")), 2).cast(MONEY).alias("amount"),
    ).where(F.col("amount") > 0)
    named = (edges.join(_name_lookup(members, "from_id", "fm"), [G, "from_id"], "left")
             .join(_name_lookup(members, "to_id", "tm"), [G, "to_id"], "left"))
    place = F.row_number().over(Window.partitionBy(G).orderBy(F.col("amount").desc(), "from_id", "to_id"))
    return named.select(G, "from_id", "to_id", _display_name("fm", "from_id").alias("from_name"),
                        _display_name("tm", "to_id").alias("to_name"), "amount", (place - 1).cast("long").alias("pos"))


def member_balances(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Per member (by name): total owed (edge sources) and to receive (edge targets).

    Endpoints that are not members are ignored; members without edges get zeros. Each
    edge is unpivoted into its two endpoints and aggregated once.
    """
    ends = edges.select(G, F.explode(F.array(
        F.struct(F.col("from_name").alias("name"), F.col("amount").alias("owes"),
                 F.lit(0).cast(MONEY).alias("recv")),
        F.struct(F.col("to_name").alias("name"), F.lit(0).cast(MONEY).alias("owes"),
                 F.col("amount").alias("recv")))).alias("e")).select(G, "e.*")
    sums = ends.groupBy(G, "name").agg(F.sum("owes").alias("owes"), F.sum("recv").alias("recv"))
    names = members.groupBy(G, "name").agg(F.min("ord").alias("ord"))
    zero = F.lit(0).cast(SUM)
    return names.join(sums, [G, "name"], "left").select(
        G, "name", money(F.round(F.coalesce("owes", zero), 2)).alias("owes"),
        money(F.round(F.coalesce("recv", zero), 2)).alias("to_receive"))


def debtor_totals(debts_raw: DataFrame, members: DataFrame) -> DataFrame:
    """Export variant: what each member owes as a debt source, unrounded, all signs kept.

    Sources that are not an integer id are skipped; members with none get 0.
    """
    f_raw = first_present(debts_raw, FROM_FIELDS, truthy=True)
    d = debts_raw.select(G, lenient_long(f_raw).alias("user_id"),
                         lenient_money(F.col("amount")).alias("amount")).where(F.col("user_id").isNotNull())
    named = d.join(members.select(G, "user_id", "name"), [G, "user_id"], "inner")
    sums = named.groupBy(G, "name").agg(F.sum("amount").alias("v"))
    names = members.groupBy(G, "name").agg(F.min("ord").alias("ord"))
    zero = F.lit(0).cast(SUM)
    return names.join(sums, [G, "name"], "left").select(
        G, F.col("name").alias("person"), money(F.coalesce("v", zero)).alias("amount"))


def top_debt(edges: DataFrame) -> DataFrame:
    """The largest edge of each group (ties: lower from_id, then to_id)."""
    return edges.where(F.col("pos") == 0).drop("pos")
