"""Presentation helpers: money text and deterministic label colours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from potluck.schemas import (
    COLOR_HUE_MOD, COLOR_LIGHT_BASE, COLOR_LIGHT_MOD, COLOR_NULL_LABEL,
    COLOR_SAT_BASE, COLOR_SAT_MOD, CURRENCY_SIGN,
)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def format_money(c) -> Column:
    """Money → ``₪1,234.50`` (null and garbage count as 0)."""
    v = F.coalesce(_col(c).cast("decimal(38,2)"), F.lit(0).cast("decimal(38,2)"))
    return F.concat(F.lit(CURRENCY_SIGN), F.format_number(v, 2))


def _hex_slice(digest: Column, start: int, length: int) -> Column:
    return F.conv(F.substring(digest, start, length), 16, 10).cast("bigint")


def label_color(c) -> Column:
    """``hsl(<h>deg <s>% <l>%)`` from the SHA-256 of the label; null/empty → 'unknown'."""
    label = _col(c).cast("string")
    label = F.when(label.isNull() | (label == ""), F.lit(COLOR_NULL_LABEL)).otherwise(label)
    digest = F.sha2(label, 256)
    hue = _hex_slice(digest, 1, 8) % COLOR_HUE_MOD
    sat = _hex_slice(digest, 9, 2) % COLOR_SAT_MOD + COLOR_SAT_BASE
    light = _hex_slice(digest, 11, 2) % COLOR_LIGHT_MOD + COLOR_LIGHT_BASE
    return F.format_string("hsl(%ddeg %d%% %d%%)", hue, sat, light)
