"""Snapshot documents read back: their values one per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from potluck.operators.tables import money_columns
from potluck.schemas import RAW_TABLE_COLUMNS

_ITEM = "array<struct<label:string,month:string,amount:double>>"
_TABLE = "struct<columns:array<string>,rows:array<map<string,string>>>"
DOCUMENT = f"""struct<group_id:bigint, group_name:string, generated_at:string, months:array<string>,
  range:struct<start_month:string,end_month:string>,
  summary:struct<expense_count:bigint,total_expenses:double,currencies:array<string>>,
  member_balances:array<struct<name:string,owes:double,to_receive:double>>,
  debt_edges:array<struct<from_id:bigint,to_id:bigint,from_name:string,to_name:string,amount:double>>,
  charts:struct<monthly_totals:{_ITEM}, category_totals_all:{_ITEM}, categories:array<string>,
    category_totals_by_month:map<string,{_ITEM}>, category_month_series:map<string,{_ITEM}>,
    person_totals_all:{_ITEM}, person_totals_by_month:map<string,{_ITEM}>>,
  tables:struct<recent_expenses:{_TABLE}, monthly_by_category:{_TABLE}, per_person_month:{_TABLE}>>"""


def document_values(documents: DataFrame) -> DataFrame:
    """``group_id, part, key, pos, label, amount``: every value of the documents.

    A document is parsed once and laid out as one array of its values, which is exploded."""
    none, no_amount = F.lit(None).cast("string"), F.lit(None).cast("double")

    def value(part: str, key: Column, pos: Column, label: Column, amount: Column) -> Column:
        return F.struct(F.lit(part).alias("part"), key.cast("string").alias("key"), pos.cast("long").alias("pos"),
                        label.cast("string").alias("label"), amount.cast("double").alias("amount"))

    def listed(part: str, path: str, label: str | None, amount: str | None, key: str | None = None) -> Column:
        return F.transform(f"d.{path}", lambda x, i: value(
            part, x[key] if key else none, i, x[label] if label else x, x[amount] if amount else no_amount))

    def keyed(part: str, label: str) -> Column:
        return F.flatten(F.transform(F.map_entries(f"d.charts.{part}"), lambda e: F.transform(
            e["value"], lambda x, i: value(part, e["key"], i, x[label], x["amount"]))))

    def rows(part: str, cell) -> Column:
        """``cell`` (row, its place, column, text) of every cell of a table."""
        return F.flatten(F.transform(f"d.tables.{part}.rows", lambda row, i: F.transform(
            F.map_entries(row), lambda e: cell(row, i, e["key"], e["value"]))))

    def month_table(part: str) -> Column:
        cells = rows(part, lambda row, i, c, v: value(part, F.try_element_at(row, F.lit("month")), i, c, v.try_cast("double")))
        return F.filter(cells, lambda x: x["label"] != "month")
    texts = [c for c in RAW_TABLE_COLUMNS if c not in money_columns(RAW_TABLE_COLUMNS)]
    recent = rows("recent_expenses", lambda _, i, c, v: F.when(c.isin(texts), value("recent_expenses", c, i, v, no_amount)).otherwise(
        value("recent_expenses", c, i, none, v.try_cast("double"))))
    one = lambda part, key, label, amount: F.array(value(part, key, F.lit(0), label, amount))
    parts = [
        one("group", F.lit("group_name"), F.col("d.group_name"), no_amount),
        one("group", F.lit("generated_at"), F.col("d.generated_at"), no_amount),
        one("range", F.lit("start_month"), F.col("d.range.start_month"), no_amount),
        one("range", F.lit("end_month"), F.col("d.range.end_month"), no_amount),
        one("summary", none, F.lit("expense_count"), F.col("d.summary.expense_count")),
        one("summary", none, F.lit("total_expenses"), F.col("d.summary.total_expenses")),
        listed("currencies", "summary.currencies", None, None), listed("months", "months", None, None),
        listed("owes", "member_balances", "name", "owes"), listed("to_receive", "member_balances", "name", "to_receive"),
        listed("debt_from", "debt_edges", "from_name", "amount", "from_id"), listed("debt_to", "debt_edges", "to_name", "amount", "to_id"),
        listed("monthly_totals", "charts.monthly_totals", "month", "amount"),
        listed("category_totals_all", "charts.category_totals_all", "label", "amount"),
        listed("categories", "charts.categories", None, None),
        listed("person_totals_all", "charts.person_totals_all", "label", "amount"),
        keyed("category_totals_by_month", "label"), keyed("category_month_series", "month"),
        keyed("person_totals_by_month", "label"), month_table("monthly_by_category"), month_table("per_person_month"),
        *[listed(f"{t}_columns", f"tables.{t}.columns", None, None) for t in ("recent_expenses", "monthly_by_category", "per_person_month")],
        recent,
    ]
    nothing = F.array().cast("array<struct<part:string,key:string,pos:bigint,label:string,amount:double>>")
    parsed = documents.select("group_id", F.from_json("snapshot", DOCUMENT).alias("d"))
    return parsed.select("group_id", F.explode(F.concat(*[F.coalesce(p, nothing) for p in parts])).alias("v")).select("group_id", "v.*")
