"""Normalization of landed expense documents into the ``expenses`` and ``shares`` tables.

Every step is a narrow ``select``/``where`` except the member-name lookup, a join with
the (small) member dimension that the planner broadcasts when its size allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from potluck.functions.numbers import lenient_cost, lenient_long, lenient_money
from potluck.schemas import (
    DEFAULT_CATEGORY, NULL_LABEL, SETTLEMENT_CATEGORY_PATTERN, UNKNOWN_PERSON,
)


def _nonempty(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def not_deleted(deleted_at: Column) -> Column:
    """A document is live when ``deleted_at`` is null or empty."""
    return F.coalesce(deleted_at, F.lit("")) == ""


def month_of(date: Column) -> Column:
    """``YYYY-MM`` from the date text; null when there is no date."""
    return F.when(_nonempty(date), F.substring(date, 1, 7))


def is_settlement(category: Column) -> Column:
    return F.lower(category).rlike(SETTLEMENT_CATEGORY_PATTERN)


def first_present(df: DataFrame, names: list[str], truthy: bool = False) -> Column:
    """First of several optional field spellings that exists in ``df`` (and is non-null).

    With ``truthy`` empty strings also fall through (Python ``a or b`` on dict payloads).
    """
    cols = []
    for n in names:
        if n in df.columns:
            c = F.col(n)
            cols.append(F.when(c.cast("string") != "", c) if truthy else c)
    if not cols:
        return F.lit(None).cast("string")
    return F.coalesce(*cols) if len(cols) > 1 else cols[0]


def latest_documents(docs: DataFrame) -> DataFrame:
    """One document per (group_id, id): the latest ``updated_at``, a missing stamp lowest.

    Runs on raw documents, before deleted ones, settlements or months are looked at, so a
    later deletion hides every earlier version. An aggregation: each task sends its best
    version of a key. Equal stamps are decided by the content's hash; documents without an
    id are all kept.
    """
    row, rank = document_rank(docs.columns)
    best = docs.where("id is not null").groupBy("group_id", "id").agg(F.max_by(row, rank).alias("d")).select("d.*")
    return best.unionByName(docs.where("id is null"))


def document_rank(columns: list[str]) -> tuple[Column, Column]:
    """A document as one value, and what it is chosen by among those of its key."""
    row = F.struct(*[F.col(c) for c in columns])
    stamp = F.when(~F.col("updated_at").isin("", NULL_LABEL), F.col("updated_at"))
    return row, F.struct(F.coalesce(stamp, F.lit("")), F.xxhash64(F.to_json(row)))


def is_expense_document() -> Column:
    """Does a document have a row in ``expenses`` that its shares find by their key?"""
    category = F.coalesce(F.col("category.name"), F.lit(DEFAULT_CATEGORY))
    return not_deleted(F.col("deleted_at")) & ~is_settlement(category) & F.col("id").isNotNull()


def flatten_docs(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nested documents (``EXPENSE_DOC``) → (headers, share rows); both narrow projections."""
    headers = docs.select(
        "group_id", "id", "date", "updated_at", "deleted_at", "cost", "currency_code",
        "description", F.col("category.name").alias("category_name"))
    users = docs.select(
        "group_id", F.col("id").alias("expense_id"), "date", "deleted_at",
        F.explode("users").alias("u"))
    entry = {f.name: f.dataType for f in docs.schema["users"].dataType.elementType.fields}

    def amount(*spellings: str) -> Column:
        """The first spelling that holds something (empty and zero values fall through)."""
        cols = [F.col(f"u.{n}").cast("string") for n in spellings if n in entry]
        return F.coalesce(*[F.when(~c.isin("", "0"), c) for c in cols]) if cols else F.lit(None).cast("string")

    shares = users.select(
        "group_id", "expense_id", "date", "deleted_at",
        lenient_long(F.coalesce(F.col("u.user_id").cast("string"), F.col("u.user.id").cast("string"))).alias("user_id"),
        F.col("u.user.first_name").alias("first_name"),
        amount("owed_share", "owedShare", "owed").alias("owed_share"),
        amount("paid_share", "paidShare", "paid").alias("paid_share"),
    )
    return headers, shares


def normalize_expenses(headers: DataFrame) -> DataFrame:
    """Headers → ``expenses``: live documents, settlements removed, defaults applied.

    Text columns render a missing value as ``None`` (as the single-group original does),
    so undated expenses are kept under the month label ``None``.
    """
    date = F.col("date")
    category = F.coalesce(F.when(F.col("category_name") != "", F.col("category_name")),
                          F.lit(DEFAULT_CATEGORY))
    out = headers.where(not_deleted(F.col("deleted_at"))).select(
        F.col("group_id").cast("long").alias("group_id"),
        F.col("id").cast("long").alias("expense_id"),
        F.coalesce(date, F.lit(NULL_LABEL)).alias("date"),
        F.coalesce(F.col("updated_at"), F.lit(NULL_LABEL)).alias("updated_at"),
        F.coalesce(month_of(date), F.lit(NULL_LABEL)).alias("month"),
        F.coalesce(F.col("description"), F.lit("")).alias("description"),
        category.alias("category"),
        lenient_cost(F.col("cost")).alias("amount"),
        F.coalesce(F.col("currency_code"), F.lit(NULL_LABEL)).alias("currency"),
    )
    return out.where(~is_settlement(F.col("category")))


def normalize_shares(rows: DataFrame, members: DataFrame) -> DataFrame:
    """Share rows → ``shares``: live, dated rows with person names and exact amounts.

    Person = member name, else first name, else the id as text, else ``Unknown``.
    Settlement documents keep their shares (only expenses drop them).
    """
    month = month_of(F.col("date"))
    live = rows.where(not_deleted(F.col("deleted_at")) & month.isNotNull()).select(
        F.col("group_id").cast("long").alias("group_id"),
        F.col("expense_id").cast("long").alias("expense_id"),
        F.col("user_id").cast("long").alias("user_id"),
        F.when(F.col("first_name") != "", F.col("first_name")).alias("first_name"),
        month.alias("month"),
        lenient_money(F.col("owed_share")).alias("owed_share"),
        lenient_money(F.col("paid_share")).alias("paid_share"),
    )
    names = members.select("group_id", "user_id", F.col("name").alias("member_name"))
    named = live.join(names, ["group_id", "user_id"], "left")
    person = F.coalesce(F.col("member_name"), F.col("first_name"),
                        F.col("user_id").cast("string"), F.lit(UNKNOWN_PERSON))
    return named.select("group_id", "expense_id", "user_id", person.alias("person"), "month",
                        "owed_share", "paid_share")
