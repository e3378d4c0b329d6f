"""Expense tables for display: member columns, search, recent rows, pages, JSON payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from potluck.functions.numbers import py_float_text
from potluck.operators.widen import OWES
from potluck.schemas import ALL_MONTHS, NULL_LABEL, OWES_SUFFIX, RAW_TABLE_COLUMNS, TABLE_LIMIT_MIN

G = "group_id"


# Columns shown for the expense table: fixed order, the members' amounts last.
RAW_COLUMNS = [*RAW_TABLE_COLUMNS, OWES]


def raw_table(wide: DataFrame) -> DataFrame:
    """The display columns that are present, after the group."""
    return wide.select(G, *[c for c in RAW_COLUMNS if c in wide.columns])


def money_columns(columns: list[str]) -> list[str]:
    """Money columns of the expense table: ``amount`` and every ``*_owes``."""
    return [c for c in columns if c == "amount" or c == OWES or c.endswith(OWES_SUFFIX)]


def pivot_money_columns(columns: list[str]) -> list[str]:
    """Money columns of the month tables: every column but the month."""
    return [c for c in columns if c not in (G, "month")]


def search_texts(df: DataFrame) -> list[Column]:
    """Each value of a row as the text a Python reader of the JSON rows would print; the
    members' amounts follow each other in member order."""
    out = []
    for f in df.schema.fields:
        col = F.col(f"`{f.name}`")
        if f.name == G:
            continue
        if isinstance(f.dataType, (T.DecimalType, T.DoubleType, T.FloatType)):
            out.append(py_float_text(col))
        elif isinstance(f.dataType, T.ArrayType):
            texts = F.array_join(F.transform(col, lambda x: py_float_text(x["amount"])), " ")
            out.append(F.when(F.size(col) > 0, texts))
        else:
            out.append(F.coalesce(col.cast("string"), F.lit(NULL_LABEL)))
    return out


def matches(df: DataFrame, query: str | None) -> Column:
    """Does the space-joined text of a row hold the query (case-insensitive)?"""
    q = (query or "").strip()
    return F.contains(F.lower(F.concat_ws(" ", *search_texts(df))), F.lit(q.lower())) if q else F.lit(True)


def search(df: DataFrame, query: str | None) -> DataFrame:
    """Rows whose space-joined values contain the query (case-insensitive)."""
    return df.where(matches(df, query))


def month_rows(cells: DataFrame, label: str, order: str | None = None) -> DataFrame:
    """Grid cells (``month, label, amount, total``) → one row per month, its cells in order.

    A row holds one group's month, so it is as long as the group's own list of labels."""
    place = F.col(order) if order else F.col(label)
    gathered = F.array_sort(F.collect_list(F.struct(place.alias("o"), F.col(label).alias("label"),
                                                    F.col("amount").alias("amount"))))
    return cells.groupBy(G, "month").agg(
        F.transform(gathered, lambda x: F.struct(x["label"].alias("label"), x["amount"].alias("amount"))).alias("cells"),
        F.first("total").alias("total"))


def in_selected_month(df: DataFrame, selected: DataFrame) -> DataFrame:
    """Rows of each group's selected month (``group_id, month``; ``all`` keeps every row).

    For the small aggregated tables. The selection is made once, from the months of the
    expense table, so a month that a table lacks leaves it empty."""
    sel = selected.select(G, F.col("month").alias("_sel"))
    return df.join(sel, G).where((F.col("_sel") == ALL_MONTHS) | (F.col("month") == F.col("_sel"))).drop("_sel")


def first_rows(df: DataFrame, n: int) -> DataFrame:
    """First ``n`` rows per group, newest date first (the id breaks ties), with ``pos`` (0-based)."""
    w = Window.partitionBy(G).orderBy(F.col("date").desc(), F.col("expense_id"))
    return df.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= n).withColumn(
        "pos", (F.col("pos") - 1).cast("long"))


def recent(wide: DataFrame, n: int) -> DataFrame:
    return first_rows(raw_table(wide), n)


def table_page(wide: DataFrame, month: str | None, query: str | None, limit: int) -> DataFrame:
    """One page of the filtered expense table plus the total count before the limit.

    Whether a group has the month, and both totals, are one partial aggregation. The page is
    one top-k per group and *kind* of row (in the month or not), which Spark limits per task
    before the shuffle; both kinds come from the same pass over the rows. Only these small
    results are joined.
    """
    limit = max(int(limit), TABLE_LIMIT_MIN)
    sel = (month or ALL_MONTHS).strip()
    base = raw_table(wide)
    rows = base.select("*", (F.col("month") == sel).alias("_in"), matches(base, query).alias("_hit"))
    info = rows.groupBy(G).agg(F.max("_in").alias("_has"), F.count_if("_hit").alias("_all"),
                               F.count_if(F.col("_hit") & F.col("_in")).alias("_sel"))
    newest = [F.col("date").desc(), F.col("expense_id")]
    top = (rows.where("_hit").withColumn("_rn", F.row_number().over(Window.partitionBy(G, "_in").orderBy(*newest)))
           .where(F.col("_rn") <= limit).join(info, G).where(~F.col("_has") | F.col("_in")))
    pos = F.row_number().over(Window.partitionBy(G).orderBy(*newest))
    total = F.when(F.col("_has"), F.col("_sel")).otherwise(F.col("_all"))
    return (top.withColumn("pos", pos).where(F.col("pos") <= limit)
            .select(*base.columns, (F.col("pos") - 1).cast("long").alias("pos"), total.alias("raw_total")))


def row_json(df: DataFrame) -> Column:
    """A row as one JSON record: numbers rounded to 2, nulls kept, ``owes`` as one
    ``<name>_owes`` key per member of the row's own group."""
    fixed, owes = [], None
    for f in df.schema.fields:
        if f.name == OWES:
            owes = F.transform(OWES, lambda x: F.struct(F.concat(x["name"], F.lit(OWES_SUFFIX)).alias("key"),
                                                        x["amount"].cast("double").alias("value")))
        elif f.name not in (G, "pos"):
            number = isinstance(f.dataType, (T.DecimalType, T.DoubleType, T.FloatType))
            col = F.col(f"`{f.name}`")
            fixed.append((F.round(col.cast("double"), 2) if number else col).alias(f.name))
    text = F.to_json(F.struct(*fixed), {"ignoreNullFields": "false"})
    if owes is None:
        return text
    members = F.to_json(F.map_from_entries(owes))
    joined = F.concat(F.substring(text, F.lit(1), F.length(text) - 1), F.lit(","),
                      F.substring(members, F.lit(2), F.length(members)))
    return F.when(F.size(OWES) > 0, joined).otherwise(text)


def table_payload(df: DataFrame) -> DataFrame:
    """Rows as JSON records beside their key."""
    return df.select(*[c for c in (G, "expense_id", "pos") if c in df.columns], row_json(df).alias("row_json"))


def payload_columns(lists: DataFrame) -> DataFrame:
    """The column names of each group's expense table (``group_id, names`` → ``columns``)."""
    own = F.transform("names", lambda n: F.concat(n, F.lit(OWES_SUFFIX)))
    return lists.select(G, F.concat(F.array(*[F.lit(c) for c in RAW_TABLE_COLUMNS]), own).alias("columns"))
