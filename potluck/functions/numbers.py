"""Lenient number and id parsing as JVM-side Column expressions (no Python UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from potluck.schemas import MONEY

DIGITS_PATTERN = r"^[0-9]+$"
SIGNED_DIGITS_PATTERN = r"^[+-]?[0-9]+$"
_EDGE_SPACE = r"^\s+|\s+$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_text(c) -> Column:
    """Trim every kind of surrounding whitespace (Python ``str.strip``)."""
    return F.regexp_replace(_col(c).cast("string"), _EDGE_SPACE, "")


def money_or_zero(text: Column) -> Column:
    """Number text → exact decimal; null, blank or unparseable → 0.

    Spark's text → decimal cast takes surrounding whitespace, signs, exponents and
    Unicode digits like Python's ``float()``, and rejects what it rejects (e.g. ``1d``,
    ``0x10``, ``1,0``). Non-finite values (``inf``/``nan``) have no decimal and become 0.
    """
    return F.coalesce(text.try_cast(MONEY), F.lit(0).cast(MONEY))


def lenient_money(c) -> Column:
    """Share/debt amounts: like :func:`lenient_cost` after removing thousands commas."""
    return money_or_zero(F.translate(_col(c).cast("string"), ",", ""))


def lenient_cost(c) -> Column:
    """Expense cost: commas are *not* removed, so ``"1,234.5"`` → 0."""
    return money_or_zero(_col(c).cast("string"))


def lenient_long(c) -> Column:
    """Integer id text with optional sign and spaces (Python ``int(text)``), else null."""
    s = strip_text(c)
    return F.when(s.rlike(SIGNED_DIGITS_PATTERN), s.try_cast(T.LongType()))


def resolve_user_id(c) -> Column:
    """Debt endpoint → user id.

    Accepts an integer, a digit-only string (no sign), or a JSON object whose first
    present key of ``id`` / ``user_id`` holds such a value. Anything else → null.
    """
    raw = _col(c).cast("string")
    s = strip_text(raw)
    direct = F.when(s.rlike(DIGITS_PATTERN), s.try_cast(T.LongType()))
    is_object = s.startswith("{")
    has_id = F.get_json_object(s, "$.id").isNotNull() | s.rlike(r'"id"\s*:')
    nested = F.when(has_id, F.get_json_object(s, "$.id")).otherwise(F.get_json_object(s, "$.user_id"))
    nested_s = strip_text(nested)
    nested_id = F.when(nested_s.rlike(SIGNED_DIGITS_PATTERN), nested_s.try_cast(T.LongType()))
    return F.when(is_object, nested_id).otherwise(direct)


def py_float_text(c) -> Column:
    """Money rounded to cents → the text Python prints for the same float (100.00 → '100.0')."""
    text = F.regexp_replace(_col(c).cast("decimal(38,2)").cast("string"), "0$", "")
    return F.when(_col(c) == 0, F.lit("0.0")).otherwise(text)            # most cells of a wide table


def pct_of_max(amount_cents: Column, max_cents: Column) -> Column:
    """round(amount / max * 100, 1) in exact integer arithmetic on cents (ties round up)."""
    a = amount_cents.cast(T.DecimalType(38, 0))
    m = max_cents.cast(T.DecimalType(38, 0))
    tenths = F.call_function("div", a * 2000 + m, m * 2)
    return F.when(m > 0, tenths / F.lit(10.0))


def cents(c) -> Column:
    """Money (decimal or double) → whole cents as long."""
    return F.round(_col(c) * 100).cast(T.LongType())
