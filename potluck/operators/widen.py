"""Per-expense member amounts: what every member of a group owes for each of its expenses.

The canonical form is one column, ``owes``: an array of (name, amount) in the order of the
group's own member map, one entry for every member (0 when none). A group never sees a
member of another one, and any number of names fits into one job. One column per member is
a presentation of a single group (``plans.views.group_tables``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from potluck.functions.numbers import py_float_text
from potluck.operators.aggregates import tracked_shares
from potluck.schemas import LEGACY_VARIANTS, OWES_SUFFIX, SUM
from potluck.sources.members import member_lists

G = "group_id"
KEY = [G, "expense_id"]
OWES = "owes"
AMOUNT = "decimal(38,2)"
FEW = 16                         # amounts of a row that are looked up one by one
# Map column of a stored table that still has one column per member: column name → amount.
MEMBER_COLUMNS = "member_columns"


def _cents(value: Column) -> Column:
    return F.round(value, 2).cast(AMOUNT)


def widen(expenses: DataFrame, shares: DataFrame, members: DataFrame, value: Column) -> DataFrame:
    """Expense table plus ``owes``; an ``owes`` column it already has is derived anew.

    Shares are summed per (expense, member) and gathered per expense, at most one entry a
    member, before the join on the full key; sums of 0 are left out until ``with_names``. The
    group's names come from one row per group, which Spark broadcasts when its size allows.
    """
    places = member_lists(members).select(G, F.posexplode("names").alias("ord", "name"))
    placed = members.select(G, "user_id", "name").join(places, [G, "name"])
    sums = tracked_shares(shares, placed).groupBy(*KEY, "ord").agg(_cents(F.sum(value).cast(SUM)).alias("amount"))
    per_expense = sums.groupBy(*KEY).agg(F.sort_array(F.collect_list(
        F.when(F.col("amount") != 0, F.struct("ord", "amount")))).alias(OWES))
    base = expenses.drop(OWES)
    # both sides grow with the data: never broadcast on the strength of a file-size estimate
    rows = base.join(per_expense.hint("merge"), KEY, "left").withColumn(
        OWES, F.coalesce(OWES, F.array().cast(f"array<struct<ord:int,amount:{AMOUNT}>>")))
    return with_names(rows.select(*[F.col(f"`{c}`") for c in base.columns], OWES), members)


def canonical_owes(store: DataFrame, members: DataFrame) -> DataFrame:
    """A stored table with ``member_columns`` → the same with ``owes``.

    Each member takes its ``<name>_owes`` column, else the first legacy spelling that the
    store has, in the fixed order of the variants; rounded, 0 when missing.
    """
    return with_names(stored_owes(store, members), members)


def stored_owes(store: DataFrame, members: DataFrame) -> DataFrame:
    """``canonical_owes`` without its names and zeros: ``owes`` holds (ord, amount) of what is
    not 0, ``ord`` the place in the group's member list. Rows stay short where they are
    shuffled and sorted; ``with_names`` fills them up.

    A stored column's name is hashed into the group's table of possible names. In rows of
    few amounts only these are looked up, and dropped where the row has an earlier spelling;
    else all columns are, and sorted by member and spelling.
    """
    keep = [F.col(f"`{c}`") for c in store.columns if c not in (MEMBER_COLUMNS, OWES)]
    none = F.array().cast("array<struct<ord:int,rank:int,value:double,before:array<string>>>")

    def found(entries: Column | str) -> Column:
        return F.flatten(F.transform(entries, lambda x: F.coalesce(F.transform(
            F.filter(F.get("_slots", F.pmod(F.xxhash64(x["key"]), F.size("_slots")).cast("int")), lambda y: y["key"] == x["key"]),
            lambda y: F.struct(y["ord"].alias("ord"), y["rank"].alias("rank"), x["value"].alias("value"), y["before"].alias("before"))), none)))
    entries, few = F.map_entries(MEMBER_COLUMNS), F.size("_some") <= FEW
    rows = store.join(_spellings(members), G, "left").select(
        *keep, MEMBER_COLUMNS, "_slots", F.filter(entries, lambda x: x["value"] != 0).alias("_some"))
    rows = rows.select(*keep, MEMBER_COLUMNS, few.alias("_few"), F.when(few, found("_some")).otherwise(
        F.sort_array(found(entries))).alias("_all"))
    earlier = F.array_intersect(F.flatten(F.transform("_all", lambda x: x["before"])), F.map_keys(MEMBER_COLUMNS))
    rows = rows.select(*keep, "_few", "_all", F.when(F.col("_few"), earlier).alias("_earlier"))
    chosen = F.when(F.col("_few"), F.sort_array(F.filter("_all", lambda x: ~F.arrays_overlap(x["before"], "_earlier")))).otherwise(
        F.filter(_first_of_each("_all"), lambda x: x["value"] != 0))
    owes = F.transform(chosen, lambda x: F.struct(x["ord"].alias("ord"), _cents(x["value"].cast(SUM)).alias("amount")))
    return rows.select(*keep, F.coalesce(owes, F.array().cast(f"array<struct<ord:int,amount:{AMOUNT}>>")).alias(OWES))


def with_names(rows: DataFrame, members: DataFrame) -> DataFrame:
    """Rows with ``stored_owes`` → the same with one (name, amount) for each of the group's
    names; rows without ``owes`` stay without.

    The entries of 0 are the group's own, taken over in runs between those that the row has."""
    zeros = member_lists(members).select(G, F.transform("names", lambda n: F.struct(
        n.alias("name"), F.lit(0).cast(AMOUNT).alias("amount"))).alias("_zeros"))
    none = F.array().cast(f"array<struct<name:string,amount:{AMOUNT}>>")
    both = rows.join(zeros, G, "left").withColumn("_zeros", F.coalesce("_zeros", none))

    def behind(i: Column) -> Column:
        """The place behind the row's own entry ``i``, from 0."""
        return F.coalesce(F.get(OWES, i)["ord"] + 1, F.lit(0))
    runs = F.transform(OWES, lambda x, i: F.concat(
        F.slice("_zeros", behind(i - 1) + 1, x["ord"] - behind(i - 1)),
        F.array(F.struct(F.get("_zeros", x["ord"])["name"].alias("name"), x["amount"].alias("amount")))))
    last = behind(F.size(OWES) - 1)
    owes = F.flatten(F.concat(runs, F.array(F.slice("_zeros", last + 1, F.size("_zeros") - last))))
    return both.select(*[owes.alias(OWES) if c == OWES else F.col(f"`{c}`") for c in rows.columns])


def _first_of_each(entries: str) -> Column:
    """Of entries sorted by ``ord``, the first of each."""
    return F.filter(entries, lambda x, i: ~F.get(entries, i - 1)["ord"].eqNullSafe(x["ord"]))


def _spellings(members: DataFrame) -> DataFrame:
    """``group_id, _slots``: every column name that a member's amount may be stored under, with
    the member's place, the spelling's rank and the spellings ``before`` it, in as many slots
    by the name's hash. One row per group, as long as the group's own configuration."""
    suffixes = F.array(*[F.lit(s) for s in (OWES_SUFFIX, *LEGACY_VARIANTS)])
    before = F.transform(F.slice(suffixes, F.lit(1), F.col("rank")), lambda s: F.concat("name", s))
    lists = member_lists(members).withColumn("_n", F.size("names") * F.size(suffixes))
    each = lists.select(G, "_n", F.posexplode("names").alias("ord", "name")).select(
        G, "_n", "ord", "name", F.posexplode(suffixes).alias("rank", "suffix")).withColumn("key", F.concat("name", "suffix"))
    entries = each.where("key is not null").select(
        G, F.pmod(F.xxhash64("key"), F.col("_n")).cast("int").alias("slot"), F.struct("key", "ord", "rank", before.alias("before")).alias("e"))
    empty = lists.select(G, F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("slot"), F.lit(None).cast(
        entries.schema["e"].dataType).alias("e"))
    slots = entries.unionByName(empty).groupBy(G, "slot").agg(F.collect_list("e").alias("es"))
    ordered = F.sort_array(F.collect_list(F.struct("slot", "es")))
    return slots.groupBy(G).agg(F.transform(ordered, lambda x: x["es"]).alias("_slots"))


def fold_member_columns(wide: DataFrame, fixed: list[str]) -> DataFrame:
    """One group's wide table → its ``fixed`` columns and the others as ``member_columns``."""
    others = [c for c in wide.columns if c not in fixed]
    entries = [x for c in others for x in (F.lit(c), F.col(f"`{c}`").try_cast("double"))]
    folded = F.create_map(*entries) if entries else F.create_map().cast("map<string,double>")
    return wide.select(*[c for c in fixed if c in wide.columns], folded.alias(MEMBER_COLUMNS))


def owes_text(owes: str = OWES) -> Column:
    """``name=amount, ...`` in member order, amounts as Python prints them."""
    return F.array_join(F.transform(owes, lambda x: F.concat(x["name"], F.lit("="), py_float_text(x["amount"]))), ", ")
