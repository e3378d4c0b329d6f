"""The ledger: normalized, exclusion-filtered tables of many groups, built lazily.

A ``Ledger`` is a bundle of lazy DataFrames. Nothing is computed until a sink or an
action runs; Catalyst prunes the columns and pushes the filters of each consumer down
to the Parquet scans. Tables a query does not use are never even planned.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from potluck.operators.exclusions import ExclusionRules, apply_exclusions
from potluck.operators.normalize import normalize_expenses, normalize_shares
from potluck.schemas import DEFAULT_DIRECTION, DIRECTIONS
from potluck.sources import fixture
from potluck.sources.members import members_from_config


def direction_mode(value: str | None) -> str:
    """``normal`` or ``reverse``; anything else (or nothing) means ``reverse``."""
    v = (value or DEFAULT_DIRECTION).strip().lower()
    return v if v in DIRECTIONS else DEFAULT_DIRECTION


@dataclass(frozen=True)
class LedgerParams:
    """Job parameters (the original reads them from its environment)."""
    debt_direction: str = DEFAULT_DIRECTION
    share_direction: str | None = None  # falls back to debt_direction
    exclusions: ExclusionRules = field(default_factory=ExclusionRules)

    @property
    def debt_mode(self) -> str:
        return direction_mode(self.debt_direction)

    @property
    def share_mode(self) -> str:
        return direction_mode(self.share_direction or self.debt_direction)


class Ledger:
    """Lazily built ledger tables.

    ``groups``: group_id, group_name, members_json · ``members``: group_id, user_id, name, ord ·
    ``raw_expenses`` / ``raw_shares``: normalized, before exclusions · ``expenses`` /
    ``shares``: after exclusions · ``debts_raw``: landed simplified debts.
    """

    def __init__(self, sources: dict[str, Callable[[], DataFrame]], params: LedgerParams | None = None):
        self._sources = sources
        self.params = params or LedgerParams()
        self._cache: dict[str, DataFrame] = {}

    def _get(self, name: str) -> DataFrame:
        if name not in self._cache:
            self._cache[name] = self._sources[name]()
        return self._cache[name]

    @property
    def groups(self) -> DataFrame:
        return self._get("groups")

    @property
    def members(self) -> DataFrame:
        return self._get("members")

    @property
    def raw_expenses(self) -> DataFrame:
        return self._get("raw_expenses")

    @property
    def raw_shares(self) -> DataFrame:
        return self._get("raw_shares")

    @property
    def debts_raw(self) -> DataFrame:
        return self._get("debts_raw")

    def _excluded(self) -> tuple[DataFrame, DataFrame]:
        if "expenses" not in self._cache:
            e, s = apply_exclusions(self.raw_expenses, self.raw_shares, self.params.exclusions)
            self._cache["expenses"], self._cache["shares"] = e, s
        return self._cache["expenses"], self._cache["shares"]

    @property
    def expenses(self) -> DataFrame:
        if not self.params.exclusions.active:
            return self.raw_expenses
        return self._excluded()[0]

    @property
    def shares(self) -> DataFrame:
        if not self.params.exclusions.active:
            return self.raw_shares
        return self._excluded()[1]

    def with_params(self, params: LedgerParams) -> "Ledger":
        return Ledger(self._sources, params)


def build(groups: DataFrame, members: DataFrame, expenses: DataFrame, shares: DataFrame,
          debts_raw: DataFrame, params: LedgerParams | None = None) -> Ledger:
    """Ledger over given (already normalized) DataFrames, e.g. hand-made test rows."""
    return Ledger({"groups": lambda: groups, "members": lambda: members, "raw_expenses": lambda: expenses,
                   "raw_shares": lambda: shares, "debts_raw": lambda: debts_raw}, params)


def from_tables(spark: SparkSession, sf_dir: str, params: LedgerParams | None = None,
                start_month: str | None = None, end_month: str | None = None) -> Ledger:
    """Ledger over the driver tables (see ``sources.fixture`` for the mapping).

    The lazy plans are memoized per session and arguments: many outputs of one job (or
    many views served from one process) share one planned ledger instead of re-analysing
    the same normalization each time. Nothing is computed or cached as data.
    """
    return _ledger_for(spark, sf_dir.rstrip("/"), params or LedgerParams(), start_month, end_month)


@functools.lru_cache(maxsize=16)
def _ledger_for(spark: SparkSession, sf_dir: str, params: LedgerParams,
                start_month: str | None, end_month: str | None) -> Ledger:
    cache: dict[str, DataFrame] = {}

    def once(name: str, make: Callable[[], DataFrame]) -> Callable[[], DataFrame]:
        def get() -> DataFrame:
            if name not in cache:
                cache[name] = make()
            return cache[name]
        return get

    groups = once("groups", lambda: fixture.group_config(spark, sf_dir))
    members = once("members", lambda: members_from_config(groups()))
    headers = once("headers", lambda: fixture.expense_headers(spark, sf_dir, start_month, end_month))
    return Ledger({
        "groups": groups,
        "members": members,
        "raw_expenses": once("e", lambda: normalize_expenses(headers())),
        "raw_shares": once("s", lambda: normalize_shares(fixture.share_rows(spark, sf_dir, headers()), members())),
        "debts_raw": once("d", lambda: fixture.debts_raw(spark, sf_dir)),
    }, params)


def with_exclusions(ledger: Ledger, rules: ExclusionRules) -> Ledger:
    return ledger.with_params(replace(ledger.params, exclusions=rules))
