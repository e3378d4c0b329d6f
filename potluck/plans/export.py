"""Batch export job: upsert the fetched expenses into the store and publish the tables.

Shape: read → normalize → exclude → upsert (full outer join on the key) → widen (join
with per-expense member sums) → pivots → publish. The merged expense table feeds three
sinks, so it is written once as the version's ``raw_expenses`` table and the other
sinks read that written table back: lineage is cut at a durable, shared location
(never a machine-local one), and a lost executor only re-runs the failed stage.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from potluck.operators import aggregates as A
from potluck.operators.upsert import sort_keys, upsert
from potluck.operators.widen import OWES, widen
from potluck.plans.ledger import Ledger
from potluck.schemas import EXPENSE_STORE
from potluck.sinks import writers


@dataclass(frozen=True)
class ExportResult:
    path: str
    version: int
    tables: tuple[str, ...]


def export(spark: SparkSession, ledger: Ledger, root: str, version: int,
           include_shares: bool = True, report_format: str = "parquet") -> ExportResult:
    """Publish ``raw_expenses`` (partitioned by month), ``raw_shares``,
    ``monthly_by_category`` and ``per_person_month`` as version ``version`` under ``root``.

    ``report_format`` (``parquet`` or ``csv``) applies to the three report tables. The
    previous published version (if any) is the store the new expenses are upserted into; rows it has that the new fetch lacks are kept, and their member columns are
    re-derived from the current shares (0 when none).
    """
    prev_v = writers.latest_version(spark, root, before=version)
    prev = None
    if prev_v is not None:
        prev = writers.read_published(spark, root, "raw_expenses", EXPENSE_STORE, version=prev_v)
    # the shares of this run give every stored row its members' amounts anew
    merged = upsert(prev.drop(OWES) if prev is not None else None, ledger.expenses)
    wide = widen(merged, ledger.shares, ledger.members, F.col("owed_share"))
    if "created_by" in wide.columns:
        wide = wide.drop("created_by")
    writers.begin(spark, root, version)
    vpath = writers.version_path(root, version)
    # 1) the shared base, written once (lineage cut at a durable location)
    stored = wide.select(*[F.col(f.name).cast(f.dataType) for f in EXPENSE_STORE.fields])
    writers.write_table(stored, f"{vpath}/raw_expenses", ["month"], sort_by=sort_keys(stored))
    base = writers.read_table(spark, f"{vpath}/raw_expenses", EXPENSE_STORE)
    # 2) the dependent tables read the written base
    tables = {
        # both pivots are written in month order (they are small, aggregated tables)
        "monthly_by_category": A.month_category_grid(base).orderBy("group_id", "month", "category"),
        "per_person_month": A.person_month(ledger.shares, ledger.members, F.col("owed_share"))
        .orderBy("group_id", "month", "ord").drop("ord").withColumn("amount", A.money("amount")),
    }
    if include_shares:
        tables["raw_shares"] = ledger.shares
    # the report tables may be written as CSV with a header; the expense table stays the
    # Parquet store that the next run upserts into
    writers.publish(spark, root, version, tables, skip_empty=tuple(tables), keep=("raw_expenses",),
                    formats={t: report_format for t in tables})
    return ExportResult(vpath, version, ("raw_expenses", *tables))
