"""Schemas of the ledger tables and the fixed values the results depend on."""

from __future__ import annotations

from pyspark.sql import types as T

# Money is an exact decimal inside every job: 24 digits before the point and 8 behind it, so
# sums never depend on the order of rows and are rounded, where they are, at the end only.
MONEY = T.DecimalType(32, 8)
SUM = T.DecimalType(38, 8)

# ---------------------------------------------------------------------------
# Fixed values (must equal the original behaviour for identical results)
# ---------------------------------------------------------------------------
# Category used when an expense has none.
DEFAULT_CATEGORY = "Uncategorized"
# Case-insensitive pattern of categories treated as settlements and dropped from expenses.
SETTLEMENT_CATEGORY_PATTERN = "payment|transfer"
# Text that a missing value becomes when a text column is rendered (Python str(None)).
NULL_LABEL = "None"
# Name used when a person has neither a member name, a first name nor an id.
UNKNOWN_PERSON = "Unknown"
# Suffix of the per-member money columns of the wide expense table.
OWES_SUFFIX = "_owes"
# Legacy per-member column spellings, in precedence order after the canonical "<name>_owes".
LEGACY_VARIANTS = ("_owed", "_paid", "_owed_x", "_owed_y", "_paid_x", "_paid_y", "_owes_x", "_owes_y")
# Debt / share direction modes; anything else means "reverse".
DIRECTIONS = ("normal", "reverse")
DEFAULT_DIRECTION = "reverse"
# Month filter value meaning "no month restriction"; label of the all-months cube row.
ALL_MONTHS = "all"
ALL_MONTHS_LABEL = "All months"
# Row label of the per-row total in pivots.
TOTAL_LABEL = "Total"
# Sort rank of months that the expense table does not know.
UNKNOWN_MONTH_RANK = 10000
# Dashboard limits: recent rows (default, floor), table rows (default, floor), bars.
RECENT_ROWS_DEFAULT, RECENT_ROWS_MIN = 30, 5
TABLE_LIMIT_DEFAULT, TABLE_LIMIT_MIN = 500, 50
CATEGORY_BARS_LIMIT = 20
MONTH_BARS_LIMIT = 120
# Refresh timer (seconds): default and floor.
REFRESH_SECONDS_DEFAULT, REFRESH_SECONDS_MIN = 900, 30
# Colour derived from SHA-256 of the label: hue 0-359, saturation 62-85 %, lightness 40-59 %.
COLOR_HUE_MOD = 360
COLOR_SAT_BASE, COLOR_SAT_MOD = 62, 24
COLOR_LIGHT_BASE, COLOR_LIGHT_MOD = 40, 20
COLOR_NULL_LABEL = "unknown"
# Currency sign of the money format.
CURRENCY_SIGN = "₪"
# Column order of the expense table shown on the dashboard (members' columns follow).
RAW_TABLE_COLUMNS = ("date", "month", "description", "category", "amount", "currency", "expense_id")
# Upsert sort keys (expense_id appended as tiebreak, Spark sorts are not stable).
UPSERT_SORT = ("date", "category", "description")

# ---------------------------------------------------------------------------
# Input schemas
# ---------------------------------------------------------------------------
# Ids may arrive as numbers or text, amounts under several names (normalize.flatten_docs).
USER_SHARE = T.StructType([
    T.StructField("user_id", T.StringType()),
    T.StructField("user", T.StructType([
        T.StructField("id", T.StringType()),
        T.StructField("first_name", T.StringType()),
    ])),
    T.StructField("owed_share", T.StringType()),
    T.StructField("owedShare", T.StringType()),
    T.StructField("owed", T.StringType()),
    T.StructField("paid_share", T.StringType()),
    T.StructField("paidShare", T.StringType()),
    T.StructField("paid", T.StringType()),
])

# One landed expense document (nested, as an expense API returns it), plus its group.
EXPENSE_DOC = T.StructType([
    T.StructField("group_id", T.LongType()),
    T.StructField("id", T.LongType()),
    T.StructField("date", T.StringType()),
    T.StructField("updated_at", T.StringType()),
    T.StructField("deleted_at", T.StringType()),
    T.StructField("cost", T.StringType()),
    T.StructField("currency_code", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("category", T.StructType([T.StructField("name", T.StringType())])),
    T.StructField("users", T.ArrayType(USER_SHARE)),
])

# Flat header of an expense document (the document without its users list).
EXPENSE_HEADER = T.StructType([
    T.StructField("group_id", T.LongType()),
    T.StructField("id", T.LongType()),
    T.StructField("date", T.StringType()),
    T.StructField("updated_at", T.StringType()),
    T.StructField("deleted_at", T.StringType()),
    T.StructField("cost", T.StringType()),
    T.StructField("currency_code", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("category_name", T.StringType()),
])

# Normalized tables.
EXPENSES = T.StructType([
    T.StructField("group_id", T.LongType()),
    T.StructField("expense_id", T.LongType()),
    T.StructField("date", T.StringType()),
    T.StructField("updated_at", T.StringType()),
    T.StructField("month", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("amount", MONEY),
    T.StructField("currency", T.StringType()),
])

# The stored expense table: columns sorted by name, with the members' amounts.
EXPENSE_STORE = T.StructType(sorted(
    [*EXPENSES.fields, T.StructField("owes", T.ArrayType(T.StructType([
        T.StructField("name", T.StringType()), T.StructField("amount", T.DecimalType(38, 2))])))],
    key=lambda f: f.name))

SHARES = T.StructType([
    T.StructField("group_id", T.LongType()),
    T.StructField("expense_id", T.LongType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("person", T.StringType()),
    T.StructField("month", T.StringType()),
    T.StructField("owed_share", MONEY),
    T.StructField("paid_share", MONEY),
])

MEMBERS = T.StructType([
    T.StructField("group_id", T.LongType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("ord", T.IntegerType()),
])

# Group configuration: the member map as a JSON object {"<user id>": "<name>", ...}.
GROUP_CONFIG = T.StructType([
    T.StructField("group_id", T.LongType()),
    T.StructField("group_name", T.StringType()),
    T.StructField("members_json", T.StringType()),
])

# Simplified debts as landed: endpoints may be ids, digit strings or {"id": ..} objects.
DEBTS_RAW = T.StructType([
    T.StructField("group_id", T.LongType()),
    *[T.StructField(f"{end}{suffix}", T.StringType()) for end in ("from", "to")
      for suffix in ("", "_user", "_user_id")],
    T.StructField("amount", T.StringType()),
])
