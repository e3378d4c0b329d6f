"""Ledger inputs derived from the driver's TPC-H-style tables.

Mapping (one expense per order, one user share per line item, one group per nation):

* expense ``id`` = ``o_orderkey``; ``group_id`` = ``c_nationkey`` of the ordering customer
* ``date`` = order date as ``YYYY-MM-DD`` text, ``updated_at`` = the full timestamp text
* ``description`` = ``o_orderpriority || ' ' || c_mktsegment``
* ``category``: ``Payment`` when key % 20 = 0, ``Bank Transfer`` when key % 31 = 0,
  none when key % 17 = 0, else ``c_mktsegment`` (first rule that matches wins)
* ``cost`` = total price as text, ``currency_code`` = ``USD`` when key % 50 = 0 else ``ILS``
* ``deleted_at`` = ``2002-01-01`` when key % 23 = 0
* share: ``user_id`` = ``l_linenumber``, ``owed_share`` = extended price; ``paid_share`` by
  return flag: A → 0, N → 2 × price, R → price
* members of group g (JSON config, in this order): users ``1 + (g + d) % 7`` for d = 0, 4, 2,
  named ``Alice``, ``<nation> 4`` and ``<nation> 2``; then ``MEMBERS_WITHOUT_SHARES`` users
  101, 102, ... named ``<nation> 101`` and so on. Ids and names differ by group; ``Alice``
  is a different user in each
* simplified debts per group: from ``l_linenumber`` to ``1 + l_suppkey % 7`` (self edges
  removed), amount = sum of extended price; even ``to`` ids arrive nested as ``{"id": n}``

The modulo rules derive attribute values; every row of every table is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from potluck.schemas import EXPENSE_DOC
from potluck.sources.calendar import in_months

# Members of a group that no line item belongs to; 25 groups then hold over 1000 names.
MEMBERS_WITHOUT_SHARES = 42


# Columns read from the driver tables, with their stored types. Declaring them skips
# footer-based schema inference and documents exactly what the ledger depends on.
TABLE_SCHEMAS = {
    "nation": "n_nationkey int, n_name string",
    "customer": "c_custkey bigint, c_nationkey int, c_mktsegment string",
    "orders": ("o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderdate timestamp_ntz, "
               "o_orderpriority string"),
    "lineitem": ("l_orderkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                 "l_extendedprice double, l_discount double, l_returnflag string"),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.read
    if name in TABLE_SCHEMAS:
        reader = reader.schema(TABLE_SCHEMAS[name])
    return reader.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def group_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per group: id, name and its member map (JSON)."""
    key, name = F.col("n_nationkey"), F.col("n_name")

    def entry(user: Column, member: Column) -> Column:
        return F.concat(F.lit('"'), user.cast("string"), F.lit('": "'), member, F.lit('"'))

    active = [entry(1 + (key + d) % 7, F.lit("Alice") if d == 0 else F.concat(name, F.lit(f" {d}"))) for d in (0, 4, 2)]
    others = F.transform(F.sequence(F.lit(101), F.lit(100 + MEMBERS_WITHOUT_SHARES)),
                         lambda i: entry(i, F.concat(name, F.lit(" "), i.cast("string"))))
    return table(spark, sf_dir, "nation").select(
        key.cast("long").alias("group_id"), name.alias("group_name"),
        F.concat(F.lit("{"), F.array_join(F.concat(F.array(*active), others), ", "), F.lit("}")).alias("members_json"))


def _money_text(c: Column) -> Column:
    return c.cast("decimal(18,2)").cast("string")


def _orders(spark: SparkSession, sf_dir: str, start_month: str | None, end_month: str | None) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")
    # Bounds on the real timestamp column so the scan can skip row groups.
    return o.where(in_months(F.col("o_orderdate"), start_month, end_month))


def expense_headers(spark: SparkSession, sf_dir: str, start_month: str | None = None,
                    end_month: str | None = None) -> DataFrame:
    """Expense documents without their users (schema ``EXPENSE_HEADER``), of whole months."""
    return _orders_of_customers(spark, sf_dir, start_month, end_month).select(*_header_columns())


def _orders_of_customers(spark: SparkSession, sf_dir: str, start_month: str | None = None,
                         end_month: str | None = None) -> DataFrame:
    o = _orders(spark, sf_dir, start_month, end_month)
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return o.join(c, o.o_custkey == c.c_custkey)


def _header_columns() -> list[Column]:
    k = F.col("o_orderkey")
    stamp = F.col("o_orderdate").cast("string")
    category = (F.when(k % 20 == 0, F.lit("Payment"))
                .when(k % 31 == 0, F.lit("Bank Transfer"))
                .when(k % 17 == 0, F.lit(None).cast("string"))
                .otherwise(F.col("c_mktsegment")))
    return [
        F.col("c_nationkey").cast("long").alias("group_id"),
        k.alias("id"),
        F.substring(stamp, 1, 10).alias("date"),
        stamp.alias("updated_at"),
        F.when(k % 23 == 0, F.lit("2002-01-01")).alias("deleted_at"),
        _money_text(F.col("o_totalprice")).alias("cost"),
        F.when(k % 50 == 0, F.lit("USD")).otherwise(F.lit("ILS")).alias("currency_code"),
        F.concat_ws(" ", F.col("o_orderpriority"), F.col("c_mktsegment")).alias("description"),
        category.alias("category_name"),
    ]


def share_rows(spark: SparkSession, sf_dir: str, headers: DataFrame | None = None) -> DataFrame:
    """User entries of the expense documents with their parent fields (schema ``SHARE_ROW``)."""
    h = (headers if headers is not None else expense_headers(spark, sf_dir)).select(
        "group_id", F.col("id").alias("expense_id"), "date", "deleted_at")
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag")
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    paid = (F.when(F.col("l_returnflag") == "A", F.lit(0).cast("decimal(18,2)"))
            .when(F.col("l_returnflag") == "N", price * 2)
            .otherwise(price))
    # Both sides are fact tables: keep the planner from broadcasting either one on the
    # strength of a compressed-file size estimate (sort-merge join, AQE handles skew).
    return li.join(h.hint("merge"), li.l_orderkey == h.expense_id).select(
        "group_id", "expense_id", "date", "deleted_at",
        F.col("l_linenumber").cast("long").alias("user_id"),
        F.lit(None).cast("string").alias("first_name"),
        price.cast("string").alias("owed_share"),
        paid.cast("decimal(18,2)").cast("string").alias("paid_share"),
    )


def debts_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simplified debts per group as landed text (schema ``DEBTS_RAW``)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    # the ends and the amount are told before the join, where they are short
    ends = li.select("l_orderkey", F.col("l_linenumber").cast("long").alias("f"), (F.col("l_suppkey") % 7 + 1).cast("long").alias("t"),
                     F.col("l_extendedprice").cast("decimal(18,2)").alias("price")).where(F.col("f") != F.col("t"))
    edges = (ends.join(o.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
             .join(c, F.col("o_custkey") == F.col("c_custkey"))
             .groupBy(F.col("c_nationkey").cast("long").alias("group_id"), "f", "t")
             .agg(F.sum("price").alias("amount")))
    to_text = F.when(F.col("t") % 2 == 0, F.format_string('{"id": %d}', F.col("t"))).otherwise(
        F.col("t").cast("string"))
    return edges.select(
        "group_id",
        F.col("f").cast("string").alias("from"),
        to_text.alias("to"),
        F.col("amount").cast("string").alias("amount"),
    )


def legacy_form(expenses: DataFrame, shares: DataFrame, members: DataFrame) -> DataFrame:
    """The expense table as an earlier run stored it: an older description, amounts as
    doubles (as re-read from a spreadsheet), and one column per member in legacy spellings,
    here as the entries of ``member_columns``. Member i (in member order) is stored as
    ``<n>_owes`` (i % 3 = 0), ``<n>_owed`` with a conflicting ``<n>_paid`` (1), ``<n>_paid_x`` (2).
    """
    from potluck.operators.widen import MEMBER_COLUMNS, widen
    old = expenses.withColumn("description", F.concat(F.lit("old "), F.col("description")))
    wide = widen(old, shares, members, F.col("owed_share"))

    def stored(x: Column, i: Column) -> Column:
        amount = x["amount"].cast("double")
        cell = lambda suffix, v: F.struct(F.concat(x["name"], F.lit(suffix)).alias("key"), v.alias("value"))
        return (F.when(i % 3 == 0, F.array(cell("_owes", amount)))
                .when(i % 3 == 1, F.array(cell("_owed", amount), cell("_paid", amount * 2)))
                .otherwise(F.array(cell("_paid_x", amount))))
    columns = F.map_from_entries(F.flatten(F.transform("owes", stored)))
    return wide.withColumn("amount", F.col("amount").cast("double")).withColumn(MEMBER_COLUMNS, columns).drop("owes")


def renumbered_store(expenses: DataFrame, shares: DataFrame, members: DataFrame) -> DataFrame:
    """A store of every expense; those with id % 3 = 2 are known there by another id (-id), so
    that a fetch of every expense meets rows of its own, sends new ones and leaves some alone."""
    k = F.col("expense_id")
    return legacy_form(expenses, shares, members).withColumn("expense_id", F.when(k % 3 == 2, -k).otherwise(k))


def landed_documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Expense documents as they land (``EXPENSE_DOC``), in two drops of several versions.

    First every document once, and those with id % 6 = 0 also in a stale version without a
    stamp. Then those with id % 4 = 0 a second later, edited, and those with id % 10 = 0 two
    seconds later, deleted. Amounts use the three spellings of the share fields by id % 3.
    """
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag")
    # rows are joined as numbers and written out as documents behind the join
    times = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 2).otherwise(1)
    entry = F.struct("l_linenumber", F.col("l_extendedprice").cast("decimal(18,2)").alias("owed"), times.alias("times"))
    entries = li.groupBy("l_orderkey").agg(F.collect_list(entry).alias("_entries"))
    spelled = F.col("o_orderkey") % 3

    def amount(value: Column, spelling: int) -> Column:
        return F.when(spelled == spelling, value.cast("decimal(18,2)").cast("string"))

    def user(x: Column) -> Column:
        return F.struct(
            x["l_linenumber"].cast("string").alias("user_id"),
            F.lit(None).cast("struct<id:string,first_name:string>").alias("user"),
            *[amount(v, i).alias(n) for v, names in ((x["owed"], ("owed_share", "owedShare", "owed")),
                                                     (x["owed"] * x["times"], ("paid_share", "paidShare", "paid")))
              for i, n in enumerate(names)])
    orders = _orders_of_customers(spark, sf_dir)
    k = F.col("o_orderkey")

    def drop(rows: DataFrame, versions: Column, changes: dict[str, dict[int, Column]]) -> DataFrame:
        """Documents of the orders, each in the given versions."""
        joined = rows.join(entries, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        docs = joined.select(*_header_columns(), F.transform("_entries", user).alias("users"), F.explode(versions).alias("_v"))
        docs = docs.withColumn("category", F.struct(F.col("category_name").alias("name")))

        def value(name: str) -> Column:
            out = F.col(name)
            for v, changed in changes.get(name, {}).items():
                out = F.when(F.col("_v") == v, changed).otherwise(out)
            return out
        return docs.select(*[value(f.name).cast(f.dataType).alias(f.name) for f in EXPENSE_DOC.fields])
    stamp, text = F.col("updated_at"), F.col("description")
    first = drop(orders, F.when(k % 6 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))), {
        "updated_at": {1: F.lit(None).cast("string")}, "description": {1: F.lit("stale")}, "cost": {1: F.lit("1")}})
    second = drop(orders.where((k % 4 == 0) | (k % 10 == 0)), F.array_compact(F.array(F.when(k % 4 == 0, 1), F.when(k % 10 == 0, 2))), {
        "updated_at": {1: F.concat(stamp, F.lit("+1")), 2: F.concat(stamp, F.lit("+2"))},
        "description": {1: F.concat(text, F.lit(" (edited)"))}, "deleted_at": {2: F.lit("2003-01-01")}})
    return first, second
