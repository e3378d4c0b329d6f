"""Property test: lenient money parsing agrees with a plain-Python model of ``float()``."""

from __future__ import annotations

import math
from decimal import ROUND_HALF_UP, Decimal, InvalidOperation

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from potluck.functions.numbers import lenient_cost, lenient_money

ALPHABET = "0123456789.,+-e "


def model(text: str | None, strip_commas: bool) -> Decimal:
    """What the ledger stores: Python's float() acceptance, 8 exact decimals, 0 otherwise."""
    if text is None:
        return Decimal("0.00")
    s = text.strip()
    if strip_commas:
        s = s.replace(",", "")
    try:
        f = float(s)
    except ValueError:
        return Decimal("0.00")
    if not math.isfinite(f) or "_" in s:
        return Decimal("0.00")
    try:
        d = Decimal(s).quantize(Decimal("0.00000001"), rounding=ROUND_HALF_UP)
    except InvalidOperation:
        return Decimal("0.00")
    return d if abs(d) < Decimal(10) ** 24 else Decimal("0.00")


@settings(max_examples=15, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=ALPHABET, max_size=9)), min_size=1, max_size=300))
def test_lenient_money_matches_model(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = df.select(lenient_money(F.col("v")).alias("m"), lenient_cost(F.col("v")).alias("c")).collect()
    for v, r in zip(values, got):
        assert r.m == model(v, strip_commas=True), v
        assert r.c == model(v, strip_commas=False), v
