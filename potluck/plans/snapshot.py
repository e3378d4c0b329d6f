"""Dashboard snapshot: every aggregate of one refresh as named lazy DataFrames.

``to_json`` renders the bounded parts per group as one JSON document per group, in the
original's nesting. The full expense table is never folded into a document: it stays a
table that is paged and searched (``plans.views.tables_view``).
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from potluck.operators import aggregates as A
from potluck.operators import debts as D
from potluck.operators.tables import month_rows, payload_columns, recent, row_json
from potluck.operators.widen import widen
from potluck.plans.ledger import Ledger
from potluck.schemas import RECENT_ROWS_DEFAULT, RECENT_ROWS_MIN, TOTAL_LABEL
from potluck.sources.members import member_lists

G = "group_id"


@dataclass
class Snapshot:
    ledger: Ledger
    recent_rows: int = RECENT_ROWS_DEFAULT
    generated_at: str | None = None
    start_month: str | None = None
    end_month: str | None = None

    @cached_property
    def raw_wide(self) -> DataFrame:
        led = self.ledger
        return widen(led.expenses, led.shares, led.members, A.net_owes(led.params.share_mode))

    @cached_property
    def sums(self) -> DataFrame:
        """The chart base: every expense chart derives from it."""
        return A.chart_base(self.ledger.expenses)

    @cached_property
    def owes_by_month(self) -> DataFrame:
        """Net owes of kept expenses per month and member (``grid`` of the person charts)."""
        led = self.ledger
        return A.person_totals_by_month(led.expenses, led.shares, led.members, led.params.share_mode)

    @cached_property
    def person_month(self) -> DataFrame:
        led = self.ledger
        return A.person_month(led.shares, led.members, A.net_owes(led.params.share_mode))

    # --- parts
    def months(self) -> DataFrame:
        return self.sums.where(F.trim("month") != "").select(G, "month").distinct()

    def summary(self) -> DataFrame:
        return A.summary(self.sums)

    def debt_edges(self) -> DataFrame:
        return D.debt_edges(self.ledger.debts_raw, self.ledger.members, self.ledger.params.debt_mode)

    def member_balances(self) -> DataFrame:
        return D.member_balances(self.debt_edges(), self.ledger.members)

    def monthly_totals(self) -> DataFrame:
        return A.monthly_totals(self.sums)

    def category_totals_all(self) -> DataFrame:
        return A.category_totals(self.sums)

    def category_totals_by_month(self) -> DataFrame:
        return A.category_by_month(self.sums)

    def category_month_series(self) -> DataFrame:
        return A.category_series(self.sums)

    def person_totals_all(self) -> DataFrame:
        """Every member's sum over the months; members of a group without expenses have 0."""
        order = A.member_order(self.ledger.members).withColumnRenamed("name", "person")
        sums = self.owes_by_month.groupBy(G, "person").agg(F.sum("amount").alias("amount"))
        return order.join(sums, [G, "person"], "left").select(G, "person", F.coalesce("amount", F.lit(0.0)).alias("amount"))

    def person_totals_by_month(self) -> DataFrame:
        return self.owes_by_month

    def recent_expenses(self) -> DataFrame:
        return recent(self.raw_wide, max(self.recent_rows, RECENT_ROWS_MIN))

    def monthly_by_category(self) -> DataFrame:
        """Month × category table, one row per month with its ``cells`` in category order."""
        return month_rows(A.month_category_grid(self.sums), "category")

    def per_person_month(self) -> DataFrame:
        """Month × person net table, one row per month with its ``cells`` in member order."""
        pm = self.person_month.withColumn("amount", A.money("amount"))
        totals = pm.where("is_total").select(G, "month", F.col("amount").alias("total"))
        return month_rows(pm.where("not is_total").join(totals, [G, "month"]), "person", "ord")

    # --- materialized base (one refresh feeds many parts)
    def materialize(self, root: str, version: int) -> "Snapshot":
        """Write the shared base tables once and return a snapshot that reads them back.

        Every part of a refresh derives from the same few tables; writing them to the shared
        folder (published version ``version`` under ``root``) computes the normalization, the
        member amounts and the chart base once and cuts the lineage, so a lost executor
        re-runs only a stage of the part being computed, never the whole ingest.
        """
        from potluck.plans.ledger import build
        from potluck.sinks import writers
        led = self.ledger
        spark = led.expenses.sparkSession
        vpath = writers.version_path(root, version)
        writers.begin(spark, root, version)

        def written(name: str, df: DataFrame) -> DataFrame:
            writers.write_table(df, f"{vpath}/{name}")
            return writers.read_table(spark, f"{vpath}/{name}", df.schema)

        base = build(written("groups", led.groups), written("members", led.members),
                     written("expenses", led.expenses), written("shares", led.shares),
                     written("debts_raw", led.debts_raw), replace(led.params, exclusions=type(led.params.exclusions)()))
        snap = Snapshot(base, self.recent_rows, self.generated_at, self.start_month, self.end_month)
        for name in ("raw_wide", "sums", "owes_by_month", "person_month"):
            snap.__dict__[name] = written(name, getattr(snap, name))
        writers.touch(spark, f"{vpath}/{writers.PUBLISHED}", str(version))
        return snap

    # --- one JSON document per group (bounded parts only)
    def to_json(self) -> DataFrame:
        """``group_id, snapshot``: the original's document; parts without rows are empty lists."""
        order_of = A.member_order(self.ledger.members).withColumnRenamed("name", "person")
        item = lambda label: [F.col(label).alias("label"), F.round("amount", 2).alias("amount")]
        month_item = [F.col("month"), F.round("amount", 2).alias("amount")]

        def listed(df: DataFrame, name: str, order: list[Column], fields: list[Column], newest: bool = False) -> DataFrame:
            """A group's rows as a list; ``order`` sorts ascending, with ``newest`` descending."""
            gathered = F.array_sort(F.collect_list(F.struct(F.struct(*[c.alias(f"_{i}") for i, c in enumerate(order)]).alias("k"),
                                                            F.struct(*fields).alias("v"))))
            values = F.transform(gathered, lambda x: x["v"])
            return df.groupBy(G).agg((F.reverse(values) if newest else values).alias(name))

        def by_key(df: DataFrame, name: str, key: str, order: list[Column], fields: list[Column]) -> DataFrame:
            """``{key: [rows]}`` of a group, keys ascending."""
            gathered = F.array_sort(F.collect_list(F.struct(F.struct(*[c.alias(f"_{i}") for i, c in enumerate(order)]).alias("k"),
                                                            F.struct(*fields).alias("v"))))
            lists = df.groupBy(G, key).agg(F.transform(gathered, lambda x: x["v"]).alias("v"))
            entries = F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.col("v"))))
            return lists.groupBy(G).agg(F.map_from_entries(entries).alias(name))

        totals = self.category_totals_all()
        by_month = self.category_totals_by_month()
        person_all = self.person_totals_all().join(order_of, [G, "person"])
        person_months = self.owes_by_month.join(order_of, [G, "person"])
        balances = self.member_balances().join(order_of.withColumnRenamed("person", "name"), [G, "name"])
        lists = payload_columns(member_lists(self.ledger.members)).withColumnRenamed("columns", "raw_columns")
        recent_rows = self.recent_expenses()
        parts = [
            listed(self.months(), "months", [F.col("month")], [F.col("month")], newest=True),
            self.summary().select(G, F.struct(
                "expense_count", F.round("total_expenses", 2).alias("total_expenses"),
                F.filter(F.split("currencies", ","), lambda c: c != "").alias("currencies")).alias("summary")),
            listed(balances, "member_balances", [F.col("ord")], [F.col("name"), F.col("owes"), F.col("to_receive")]),
            listed(self.debt_edges(), "debt_edges", [F.col("pos")],
                   [F.col("from_id"), F.col("to_id"), F.col("from_name"), F.col("to_name"), A.money("amount").alias("amount")]),
            listed(self.monthly_totals(), "monthly_totals", [F.col("month")], month_item, newest=True),
            listed(totals, "category_totals_all", [-F.col("amount"), F.col("category")], item("category")),
            by_key(by_month, "category_totals_by_month", "month", [-F.col("amount"), F.col("category")], item("category")),
            by_key(self.category_month_series(), "category_month_series", "category", [F.col("pos")], month_item),
            listed(totals, "categories", [F.col("category")], [F.col("category")]),
            listed(person_all, "person_totals_all", [F.col("ord")], item("person")),
            by_key(person_months, "person_totals_by_month", "month", [F.col("ord")], item("person")),
            _table(self.monthly_by_category(), "monthly_by_category"),
            _table(self.per_person_month(), "per_person_month", newest=True),
            listed(recent_rows.select(G, "pos", row_json(recent_rows).alias("row")), "recent_rows", [F.col("pos")],
                   [F.col("row")]),
            lists,
        ]
        doc = self.ledger.groups.select(G, "group_name")
        for p in parts:
            doc = doc.join(p, G, "left")
        text = lambda c: _json_or(c, "[]")
        names = lambda c, f: _json_or(F.transform(c, lambda x: x[f]), "[]")
        table = lambda c: F.coalesce(F.col(c), F.lit('{"columns":[],"rows":[]}'))
        recent_table = F.concat(F.lit('{"columns":'), F.when(F.col("recent_rows").isNull(), F.lit("[]")).otherwise(
            _json_or(F.col("raw_columns"), "[]")), F.lit(',"rows":['), F.coalesce(F.array_join(F.transform(
                "recent_rows", lambda x: x["row"]), ","), F.lit("")), F.lit("]}"))
        head = F.struct(F.col(G), "group_name", F.lit(self.generated_at).alias("generated_at"))
        span = F.struct(F.lit(self.start_month).alias("start_month"), F.lit(self.end_month).alias("end_month"))
        keep = {"ignoreNullFields": "false"}
        charts = [("monthly_totals", text("monthly_totals")), ("category_totals_all", text("category_totals_all")),
                  ("category_totals_by_month", _json_or(F.col("category_totals_by_month"), "{}")),
                  ("category_month_series", _json_or(F.col("category_month_series"), "{}")),
                  ("categories", names("categories", "category")), ("person_totals_all", text("person_totals_all")),
                  ("person_totals_by_month", _json_or(F.col("person_totals_by_month"), "{}"))]
        tables = [("recent_expenses", recent_table), ("monthly_by_category", table("monthly_by_category")),
                  ("per_person_month", table("per_person_month"))]
        body = F.to_json(head, keep)
        fields = [("months", names("months", "month")), ("range", F.to_json(span, keep)),
                  ("summary", _json_or(F.col("summary"), '{"expense_count":0,"total_expenses":0.0,"currencies":[]}')),
                  ("member_balances", text("member_balances")), ("debt_edges", text("debt_edges")),
                  ("charts", _object(charts)), ("tables", _object(tables))]
        whole = F.concat(F.substring(body, F.lit(1), F.length(body) - 1), F.lit(","), _members(fields), F.lit("}"))
        return doc.select(G, whole.alias("snapshot"))


def _json_or(value: Column | str, empty: str) -> Column:
    col = F.col(value) if isinstance(value, str) else value
    return F.coalesce(F.to_json(col), F.lit(empty))


def _members(fields: list[tuple[str, Column]]) -> Column:
    """``"name":<json>`` of each field, comma-joined."""
    return F.concat_ws(",", *[F.concat(F.lit(f'"{name}":'), value) for name, value in fields])


def _object(fields: list[tuple[str, Column]]) -> Column:
    return F.concat(F.lit("{"), _members(fields), F.lit("}"))


def _table(rows: DataFrame, name: str, newest: bool = False) -> DataFrame:
    """Month rows (``month, cells, total``) → one ``{columns, rows}`` text per group.

    A label that equals the total's name gives way to the total, as a later column of the
    same name does in the original."""
    kept = F.filter("cells", lambda x: x["label"] != TOTAL_LABEL)
    record = F.to_json(F.map_from_entries(F.concat(
        F.transform(kept, lambda x: F.struct(x["label"].alias("key"), F.round(x["amount"], 2).alias("value"))),
        F.array(F.struct(F.lit(TOTAL_LABEL).alias("key"), F.round("total", 2).alias("value"))))))
    month = F.to_json(F.struct("month"))
    row = F.concat(F.substring(month, F.lit(1), F.length(month) - 1), F.lit(","), F.substring(record, F.lit(2), F.length(record)))
    gathered = F.transform(F.array_sort(F.collect_list(F.struct(F.col("month").alias("k"), row.alias("v")))), lambda x: x["v"])
    gathered = F.reverse(gathered) if newest else gathered
    labels = F.first(F.transform(kept, lambda x: x["label"]))
    columns = F.to_json(F.concat(F.array(F.lit("month")), labels, F.array(F.lit(TOTAL_LABEL))))
    return rows.groupBy(G).agg(F.concat(
        F.lit('{"columns":'), columns, F.lit(',"rows":['), F.array_join(gathered, ","), F.lit("]}")).alias(name))
