"""Registered queries: one callable per operator of the ledger, ``(spark, sf_dir) → DataFrame``.

Every query reads the driver tables (through ``plans.ledger.from_tables``) in full.
Parameters used by the parameterized operators are fixed here so that each query has
one well-defined answer; the same values appear in ``potluck.oracle_sql``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from potluck.operators import aggregates as A
from potluck.plans.ledger import from_tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# ------------------------------------------------------------------ expense aggregates
@query
def month_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.month_category(from_tables(spark, sf_dir).expenses)


def doubles(df: DataFrame) -> DataFrame:
    """Cast every decimal column to double (exact decimals → output type)."""
    from pyspark.sql import functions as F
    from pyspark.sql.types import DecimalType
    return df.select(*[F.col(f"`{f.name}`").cast("double").alias(f.name) if isinstance(f.dataType, DecimalType)
                       else F.col(f"`{f.name}`") for f in df.schema.fields])


@query
def month_category_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Month × category table of every group, zero-filled, with the month's total beside."""
    return A.month_category_grid(from_tables(spark, sf_dir).expenses)


@query
def monthly_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.monthly_totals(from_tables(spark, sf_dir).expenses)


@query
def category_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.category_totals(from_tables(spark, sf_dir).expenses)


@query
def category_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.category_by_month(from_tables(spark, sf_dir).expenses)


@query
def category_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.category_cube(from_tables(spark, sf_dir).expenses)


@query
def category_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.category_series(from_tables(spark, sf_dir).expenses)


@query
def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.summary(from_tables(spark, sf_dir).expenses)


@query
def multi_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.multi_currency(from_tables(spark, sf_dir).expenses)


@query
def distinct_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.distinct_values(from_tables(spark, sf_dir).expenses)


SCOPED_MONTH = "1997-06"


@query
def scoped_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.scoped_month(from_tables(spark, sf_dir).expenses, SCOPED_MONTH)


@query
def normalize_expenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubles(from_tables(spark, sf_dir).expenses)


SCAN_START, SCAN_END = "1996-01", "1997-12"


@query
def scan_month_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expenses of a month range; the bounds reach the Parquet scan as pushed filters."""
    return doubles(from_tables(spark, sf_dir, start_month=SCAN_START, end_month=SCAN_END).expenses)


# ------------------------------------------------------------------ shares
@query
def explode_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubles(from_tables(spark, sf_dir).shares)


@query
def person_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_tables(spark, sf_dir).shares.select("group_id", "user_id", "person").distinct()


@query
def net_owes_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F
    led = from_tables(spark, sf_dir)
    t = A.tracked_shares(led.shares, led.members)
    return t.select("group_id", "expense_id", "user_id", F.col("member").alias("person"), "month",
                    A.money(A.net_owes(led.params.share_mode)).alias("net_owes"))


@query
def person_month_owed(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = from_tables(spark, sf_dir)
    return A.person_month_owed(led.shares, led.members)


@query
def person_month_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = from_tables(spark, sf_dir)
    return A.person_month_net(led.shares, led.members, led.params.share_mode)


def shown(wide: DataFrame) -> DataFrame:
    """A table with ``owes`` for output: doubles, and the members' amounts as text."""
    from potluck.operators.widen import OWES, owes_text
    return doubles(wide.withColumn(OWES, owes_text()))


def _widen(spark: SparkSession, sf_dir: str, net: bool) -> DataFrame:
    from pyspark.sql import functions as F
    from potluck.operators.widen import widen
    led = from_tables(spark, sf_dir)
    value = A.net_owes(led.params.share_mode) if net else F.col("owed_share")
    return shown(widen(led.expenses, led.shares, led.members, value))


@query
def widen_owes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _widen(spark, sf_dir, net=False)


@query
def widen_net_owes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _widen(spark, sf_dir, net=True)


@query
def person_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = from_tables(spark, sf_dir)
    return A.person_totals(led.expenses, led.shares, led.members, led.params.share_mode)


@query
def person_totals_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = from_tables(spark, sf_dir)
    return A.person_totals_by_month(led.expenses, led.shares, led.members, led.params.share_mode)


@query
def share_sanity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.share_sanity(from_tables(spark, sf_dir).shares)


@query
def share_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share sanity peek: first 6 shares of each group in key order."""
    return doubles(A.share_sample(from_tables(spark, sf_dir).shares, 6))


@query
def top_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = from_tables(spark, sf_dir)
    return A.top_people(led.shares, led.members, k=2)


# ------------------------------------------------------------------ calendar
@query
def month_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    from potluck.sources.calendar import group_calendar
    return group_calendar(from_tables(spark, sf_dir).expenses)


@query
def month_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    from potluck.sources.calendar import calendar_bounds, group_calendar
    return calendar_bounds(group_calendar(from_tables(spark, sf_dir).expenses))


# ------------------------------------------------------------------ exclusions, upsert
from potluck.operators.exclusions import ExclusionRules  # noqa: E402

# Exclusion parameters (blank entries and spaces are ignored, months de-duplicated).
EXCLUSION_RULES = ExclusionRules.of("1996-03, 1997-06,,1998-01 ,1996-03", " urgent, BUILDING ,")


@query
def exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares after the exclusion rules (semi join to kept expenses)."""
    from potluck.plans.ledger import LedgerParams
    led = from_tables(spark, sf_dir, LedgerParams(exclusions=EXCLUSION_RULES))
    return doubles(led.shares)


@query
def exclusion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from potluck.operators.exclusions import exclusion_counts as counts
    led = from_tables(spark, sf_dir)
    return counts(led.raw_expenses, led.raw_shares, EXCLUSION_RULES)


def _ledger_and_store(spark: SparkSession, sf_dir: str):
    from potluck.sources import fixture
    led = from_tables(spark, sf_dir)
    return led, fixture.renumbered_store(led.expenses, led.shares, led.members)


@query
def legacy_owes_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from potluck.operators.widen import canonical_owes
    led, store = _ledger_and_store(spark, sf_dir)
    return shown(canonical_owes(store, led.members))


@query
def upsert_expenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store, merged with a fetch of every expense, in each group's presentation order (``pos``)."""
    from potluck.operators.upsert import upsert, with_position
    from potluck.operators.widen import stored_owes, with_names
    led, store = _ledger_and_store(spark, sf_dir)
    # the members' names and zeros are filled in when the rows stand in their places
    return shown(with_names(with_position(upsert(stored_owes(store, led.members), led.expenses)), led.members))


@query
def new_expenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from potluck.operators.upsert import new_rows
    led, store = _ledger_and_store(spark, sf_dir)
    return doubles(new_rows(store, led.expenses))


# ------------------------------------------------------------------ trends
@query
def mom_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    from potluck.operators.trends import mom_full as mf
    return mf(from_tables(spark, sf_dir).expenses)


@query
def mom_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    from potluck.operators.trends import mom_delta as md
    return md(from_tables(spark, sf_dir).expenses)


@query
def mom_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    from potluck.operators.trends import mom_pct as mp
    return mp(from_tables(spark, sf_dir).expenses)


# ------------------------------------------------------------------ debts
def _edges(spark: SparkSession, sf_dir: str):
    from potluck.operators.debts import debt_edges as de
    led = from_tables(spark, sf_dir)
    return led, de(led.debts_raw, led.members, led.params.debt_mode)


@query
def debt_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubles(_edges(spark, sf_dir)[1])


@query
def member_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    from potluck.operators.debts import member_balances as mb
    led, edges = _edges(spark, sf_dir)
    return mb(edges, led.members)


@query
def debtor_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    from potluck.operators.debts import debtor_totals as dt
    led = from_tables(spark, sf_dir)
    return dt(led.debts_raw, led.members)


@query
def top_debt(spark: SparkSession, sf_dir: str) -> DataFrame:
    from potluck.operators.debts import top_debt as td
    return doubles(td(_edges(spark, sf_dir)[1]))


# ------------------------------------------------------------------ charts, tables, formats
def _raw_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dashboard expense table: expenses + every member's net amounts (decimal money)."""
    from potluck.operators.widen import widen
    led = from_tables(spark, sf_dir)
    return widen(led.expenses, led.shares, led.members, A.net_owes(led.params.share_mode))


@query
def bars_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top 20 categories over all months, percent of max, coloured by label."""
    from pyspark.sql import functions as F
    from potluck.operators.bars import bars
    from potluck.schemas import CATEGORY_BARS_LIMIT
    s = from_tables(spark, sf_dir).expenses.groupBy("group_id", "category").agg(F.sum("amount").alias("amount"))
    return bars(s, "category", [F.col("amount").desc(), F.col("category")], CATEGORY_BARS_LIMIT, color=True)


@query
def bars_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly totals, newest first, at most 120 bars."""
    from pyspark.sql import functions as F
    from potluck.operators.bars import bars
    from potluck.schemas import MONTH_BARS_LIMIT
    s = from_tables(spark, sf_dir).expenses.groupBy("group_id", "month").agg(F.sum("amount").alias("amount"))
    return bars(s, "month", [F.col("month").desc()], MONTH_BARS_LIMIT)


SERIES_CATEGORY = "HOUSEHOLD"


@query
def bars_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Month series of the selected category (invalid → first category), at most 120 bars."""
    from pyspark.sql import functions as F
    from potluck.operators.bars import bars
    from potluck.plans.views import selected_category
    from potluck.schemas import MONTH_BARS_LIMIT
    e = from_tables(spark, sf_dir).expenses
    sel = selected_category(e, SERIES_CATEGORY)
    # aggregate first (partial sums), then pick the selected series: small ⋈ small
    s = A.month_category_sums(e).join(sel, ["group_id", "category"], "left_semi").select(
        "group_id", "month", "amount")
    return bars(s, "month", [F.col("month").desc()], MONTH_BARS_LIMIT)


@query
def person_month_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F
    from potluck.operators.bars import person_month_groups as pmg
    led = from_tables(spark, sf_dir)
    pm = A.person_month(led.shares, led.members, A.net_owes(led.params.share_mode))
    months = led.expenses.where(F.trim("month") != "").select("group_id", "month").distinct()
    return pmg(pm.drop("ord"), months)


@query
def recent_expenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from potluck.operators.tables import recent
    from potluck.schemas import RECENT_ROWS_DEFAULT
    return shown(recent(_raw_wide(spark, sf_dir), RECENT_ROWS_DEFAULT))


SEARCH_QUERY = " High AUTO "
PAGE_MONTH = "1997-06"


@query
def text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from potluck.operators.tables import raw_table, search
    return shown(search(raw_table(_raw_wide(spark, sf_dir)), SEARCH_QUERY))


@query
def table_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    from potluck.operators.tables import table_page as tp
    from potluck.schemas import TABLE_LIMIT_DEFAULT
    return shown(tp(_raw_wide(spark, sf_dir), PAGE_MONTH, "urgent", TABLE_LIMIT_DEFAULT))


@query
def format_money(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The money columns of the expense table rendered as currency text."""
    from pyspark.sql import functions as F
    from potluck.functions.format import format_money as fm
    wide = _raw_wide(spark, sf_dir)
    owes = F.array_join(F.transform("owes", lambda x: F.concat(x["name"], F.lit(" "), fm(x["amount"]))), "; ")
    return wide.select("group_id", "expense_id", fm(F.col("amount")).alias("amount_text"), owes.alias("owes_text"))


@query
def label_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colour of every chart label: categories and person names."""
    from pyspark.sql import functions as F
    from potluck.functions.format import label_color as lc
    led = from_tables(spark, sf_dir)
    labels = (led.expenses.select(F.col("category").alias("label"))
              .unionByName(led.shares.select(F.col("person").alias("label"))).distinct())
    return labels.select("label", lc("label").alias("color"))


@query
def table_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    from potluck.operators.tables import raw_table, table_payload as tp
    return tp(raw_table(_raw_wide(spark, sf_dir)))


@query
def payload_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The column list of each group's expense table."""
    from pyspark.sql import functions as F
    from potluck.operators.tables import payload_columns as pc
    from potluck.sources.members import member_lists
    return pc(member_lists(from_tables(spark, sf_dir).members)).withColumn("columns", F.array_join("columns", ","))


@query
def coerce_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lenient number parsing of money text as it arrives (thousands commas, junk)."""
    from pyspark.sql import functions as F
    from potluck.functions.numbers import lenient_cost, lenient_money
    from potluck.sources.fixture import table
    li = table(spark, sf_dir, "lineitem")
    comma = F.format_number(F.col("l_extendedprice"), 2)
    junk = F.concat(F.lit(" "), F.col("l_quantity").cast("string"), F.lit("d"))
    spaced = F.concat(F.lit("  "), F.col("l_discount").cast("string"), F.lit(" "))
    return li.select(
        "l_orderkey", "l_linenumber", comma.alias("raw_comma"),
        A.money(lenient_money(comma)).alias("share_value"), A.money(lenient_cost(comma)).alias("cost_value"),
        junk.alias("raw_junk"), A.money(lenient_money(junk)).alias("junk_value"),
        A.money(lenient_cost(spaced)).alias("spaced_value"))


@query
def members_from_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_tables(spark, sf_dir).members


# Amounts with sub-cent digits and beyond 1e16, as text: sums stay exact and are not cut.
@query
def exact_money(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F
    from potluck.functions.numbers import lenient_money
    from potluck.sources.fixture import table
    li = table(spark, sf_dir, "lineitem")
    tiny = F.concat(F.lit("0.00"), F.col("l_linenumber").cast("string"))
    huge = F.concat(F.col("l_linenumber").cast("string"), F.lit("e17"))
    return li.groupBy(F.col("l_suppkey").alias("suppkey")).agg(
        F.sum(lenient_money(tiny)).cast("string").alias("tiny_sum"),
        F.sum(lenient_money(huge)).cast("decimal(38,0)").cast("string").alias("huge_sum"))


# ------------------------------------------------------------------ landed documents
@query
def latest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest version of every landed document: re-sent, deleted and unstamped ones."""
    from pyspark.sql import functions as F
    from potluck.operators.normalize import latest_documents as ld
    from potluck.sources import fixture
    first, second = fixture.landed_documents(spark, sf_dir)
    return ld(first.unionByName(second)).select("group_id", "id", "updated_at", "deleted_at", "description", "cost",
                                                F.coalesce(F.size("users"), F.lit(0)).cast("long").alias("n_users"))


@query
def landed_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of the ledger that the landed documents give."""
    return A.summary(_landed_ledger(spark, sf_dir).expenses)


@query
def landed_person_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owed shares per month and member of the landed documents, in all field spellings."""
    led = _landed_ledger(spark, sf_dir)
    return A.person_month_owed(led.shares, led.members)


def _landed_ledger(spark: SparkSession, sf_dir: str):
    from potluck.sources import fixture
    from potluck.sources.docs import ledger_from_docs
    led = from_tables(spark, sf_dir)
    first, second = fixture.landed_documents(spark, sf_dir)
    return ledger_from_docs(first.unionByName(second), led.groups, led.debts_raw)


# ------------------------------------------------------------------ composed plans
VIEW_MONTH = "1997-06"


def _snapshot(spark: SparkSession, sf_dir: str):
    from potluck.plans.snapshot import Snapshot
    return Snapshot(from_tables(spark, sf_dir), generated_at="1970-01-01T00:00:00+00:00",
                    start_month="1995-01", end_month="2001-12")


def _refreshed(spark: SparkSession, sf_dir: str):
    """A dashboard refresh: its base is written once to the shared folder and read back."""
    return _snapshot(spark, sf_dir).materialize(_scratch(spark, "snapshots"), version=1)


@query
def snapshot_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON dashboard documents, read back and laid out one value per row."""
    from potluck.plans.documents import document_values
    return document_values(_refreshed(spark, sf_dir).to_json())


@query
def dashboard_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dashboard header per group for category month 1997-06, an invalid person month and
    an invalid category (both fall back), served from the refreshed snapshot."""
    from potluck.plans.views import dashboard_view as dv
    return dv(_refreshed(spark, sf_dir), VIEW_MONTH, "1999-13", "Nope")["header"]


@query
def dashboard_category_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The category bars of the chosen month."""
    from potluck.plans.views import dashboard_view as dv
    return dv(_snapshot(spark, sf_dir), VIEW_MONTH, None, None)["category_bars"]


@query
def dashboard_person_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The person bars of the chosen month."""
    from potluck.plans.views import dashboard_view as dv
    return dv(_snapshot(spark, sf_dir), None, VIEW_MONTH, None)["person_month_groups"]


@query
def tables_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables page header per group (month 1997-06, text "urgent", limit floored to 50)."""
    from potluck.plans.views import tables_view as tv
    return tv(_refreshed(spark, sf_dir), VIEW_MONTH, "urgent", 10)["header"]


def _cells(rows: DataFrame) -> DataFrame:
    from pyspark.sql import functions as F
    return rows.select("group_id", "month", F.posexplode("cells").alias("pos", "c"), "total").select(
        "group_id", "month", "pos", "c.label", "c.amount", "total")


@query
def tables_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The month × category rows of the tables page for the chosen month."""
    from potluck.plans.views import tables_view as tv
    return _cells(tv(_snapshot(spark, sf_dir), VIEW_MONTH, None, None)["monthly"])


@query
def tables_person(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The month × person rows of the tables page that contain a text."""
    from potluck.plans.views import tables_view as tv
    return _cells(tv(_snapshot(spark, sf_dir), "all", "97-", None)["person"])


def _scratch(spark: SparkSession, kind: str) -> str:
    """A fresh folder for this run inside the shared checkpoint folder."""
    import uuid
    from potluck.session import shared_path
    return shared_path(spark, "potluck", kind, uuid.uuid4().hex)


@query
def sink_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publish an export (expenses partitioned by month, shares, pivots) and read it back."""
    from potluck.plans.export import export
    from potluck.schemas import EXPENSE_STORE
    from potluck.sinks.writers import read_published
    root = _scratch(spark, "exports")
    export(spark, from_tables(spark, sf_dir), root, version=1)
    return shown(read_published(spark, root, "raw_expenses", EXPENSE_STORE))


@query
def sink_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The published share table, read back and summed up per group and month."""
    from pyspark.sql import functions as F
    from potluck.plans.export import export
    from potluck.sinks.writers import read_published
    root = _scratch(spark, "exports")
    export(spark, from_tables(spark, sf_dir), root, version=1)
    return doubles(read_published(spark, root, "raw_shares").groupBy("group_id", "month").agg(
        F.count("*").alias("n"), F.sum("owed_share").alias("owed"), F.sum("paid_share").alias("paid")))


def _streamed(spark: SparkSession, sf_dir: str):
    """Landed documents → Structured Streaming (availableNow) → ledger over the store."""
    from potluck.sources import fixture
    from potluck.sources.docs import ledger_from_docs
    from potluck.streaming import upsert_stream as S
    base = _scratch(spark, "stream")
    first, second = fixture.landed_documents(spark, sf_dir)
    for name, drop in (("a", first), ("b", second)):
        drop.write.option("compression", "zstd").parquet(f"{base}/landing/{name}")
    S.start(spark, f"{base}/landing/*", f"{base}/store", f"{base}/checkpoint", available_now=True).awaitTermination()
    led = from_tables(spark, sf_dir)
    return ledger_from_docs(S.current_documents(spark, f"{base}/store"), led.groups, led.debts_raw, latest=True)


@query
def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expenses of the streamed document store."""
    return doubles(_streamed(spark, sf_dir).expenses)


@query
def stream_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of the streamed document store."""
    return doubles(_streamed(spark, sf_dir).shares)


@query
def stream_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dashboard published with the second of two streamed drops: the sums of the first
    brought forward by the edits and deletions of the second."""
    from potluck.plans.documents import document_values
    from potluck.sources import fixture
    from potluck.sources.docs import read_debts
    from potluck.streaming import upsert_stream as S
    from potluck.streaming.dashboard import Dashboard
    base, led = _scratch(spark, "stream"), from_tables(spark, sf_dir)
    led.debts_raw.write.parquet(f"{base}/debts")        # landed once, read by each refresh
    dashboard = Dashboard(lambda _: led.groups, lambda s: read_debts(s, f"{base}/debts", "parquet"),
                          generated_at=lambda: "1970-01-01T00:00:00+00:00")
    for name, drop in zip("ab", fixture.landed_documents(spark, sf_dir)):
        drop.write.option("compression", "zstd").parquet(f"{base}/landing/{name}")
        S.start(spark, f"{base}/landing/*", f"{base}/store", f"{base}/checkpoint", available_now=True,
                dashboard=dashboard).awaitTermination()
    return document_values(S.current_dashboard(spark, f"{base}/store"))
