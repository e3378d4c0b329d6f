"""Landed inputs: nested expense documents, group configuration and simplified debts.

Documents land as JSON lines or Parquet (one document per line/row, the shape an expense
API returns, plus its ``group_id``). They are always read with the explicit schema — no
inference pass over the data — and month ranges are expressed on the date column so the
bounds reach the scan (string bounds on ISO dates are pushed down to Parquet).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from potluck.operators.normalize import (
    flatten_docs, is_expense_document, latest_documents, normalize_expenses, normalize_shares,
)
from potluck.plans.ledger import Ledger, LedgerParams, build
from potluck.schemas import DEBTS_RAW, EXPENSE_DOC, GROUP_CONFIG
from potluck.sources.calendar import month_start
from potluck.sources.members import members_from_config


def _read(spark: SparkSession, path: str, schema, fmt: str) -> DataFrame:
    return spark.read.schema(schema).format(fmt).load(path)


CORRUPT = "_corrupt"


def read_docs(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Landed documents; JSON lines that cannot be parsed are left out (``rejected_docs``)."""
    if fmt != "json":
        return _read(spark, path, EXPENSE_DOC, fmt)
    return _with_corrupt(spark, path).where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def rejected_docs(spark: SparkSession, path: str) -> DataFrame:
    """The JSON lines that ``read_docs`` leaves out, as ``line``."""
    return _with_corrupt(spark, path).where(F.col(CORRUPT).isNotNull()).select(F.col(CORRUPT).alias("line"))


def _with_corrupt(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType([*EXPENSE_DOC.fields, T.StructField(CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema, options).alias("d")).select("d.*")


def read_groups(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return _read(spark, path, GROUP_CONFIG, fmt)


def read_debts(spark: SparkSession, path: str | None, fmt: str = "json") -> DataFrame:
    if not path:
        return spark.createDataFrame([], DEBTS_RAW)
    return _read(spark, path, DEBTS_RAW, fmt)


def month_range(docs: DataFrame, start_ym: str | None, end_ym: str | None) -> DataFrame:
    """Documents dated in the months ``start_ym`` … ``end_ym`` (inclusive, ``YYYY-MM``)."""
    if start_ym and end_ym and end_ym < start_ym:
        raise ValueError(f"the end {end_ym} is before the start {start_ym}")
    if start_ym:
        docs = docs.where(F.col("date") >= F.date_format(month_start(start_ym), "yyyy-MM-dd"))
    if end_ym:
        docs = docs.where(F.col("date") < F.date_format(month_start(end_ym, 1), "yyyy-MM-dd"))
    return docs


def ledger_from_docs(docs: DataFrame, groups: DataFrame, debts: DataFrame,
                     params: LedgerParams | None = None, group_ids: list[int] | None = None,
                     start_ym: str | None = None, end_ym: str | None = None, latest: bool = False) -> Ledger:
    """Ledger over landed documents: latest versions, months, flatten, normalize, exclude.

    A version's month counts only after the latest one is chosen: a document that moved to
    another month is in that month alone. ``latest``: the documents are the latest already, as
    a document store's are; they are then not gathered by key again."""
    if group_ids:
        docs = docs.where(F.col("group_id").isin(group_ids))
        groups = groups.where(F.col("group_id").isin(group_ids))
        debts = debts.where(F.col("group_id").isin(group_ids))
    members = members_from_config(groups)
    headers, share_rows = flatten_docs(month_range(docs if latest else latest_documents(docs), start_ym, end_ym))
    return build(groups, members, normalize_expenses(headers), normalize_shares(share_rows, members),
                 debts, params)


def marked_shares(docs: DataFrame, members: DataFrame) -> DataFrame:
    """The shares of latest documents with ``kept``: are they of an expense (not of a settlement
    or a document without an id)? Told from the document itself, so no share is looked up."""
    def of(kept: bool) -> DataFrame:
        part = docs.where(is_expense_document() if kept else ~is_expense_document())
        return normalize_shares(flatten_docs(part)[1], members).withColumn("kept", F.lit(kept))
    return of(True).unionByName(of(False))
