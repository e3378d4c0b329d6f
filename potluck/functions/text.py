"""Text predicates and helpers as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from potluck.schemas import NULL_LABEL


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def contains_all_ci(text, needles: list[str]) -> Column:
    """True when ``text`` contains every literal needle, case-insensitively (not regex)."""
    low = F.lower(F.coalesce(_col(text).cast("string"), F.lit(NULL_LABEL)))
    if not needles:
        return F.lit(True)
    return reduce(lambda acc, n: acc & F.contains(low, F.lit(n.lower())), needles, F.lit(True))


def nonblank(c) -> Column:
    return F.trim(_col(c).cast("string")) != ""
