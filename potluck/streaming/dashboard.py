"""A refresh that ends in a published dashboard, brought forward by what a batch changed.

Every chart of the dashboard derives from two tables of sums, ``sums`` (month × category ×
currency) and ``member_sums`` (month × member), and from each group's newest rows. Sums are
exact decimals with the number of rows behind each, so a batch is a signed delta: the old
versions of its documents are taken off, the new ones are added, and sums without rows go.
Documents that a batch does not touch are not read.

The newest rows are kept beyond those that are shown (``SPARE``), with the place behind which
rows are not known. Rows of touched documents are taken out and the new versions put beside
the rest; what stands before that place is then complete. Groups that have fewer such rows
than are shown are filled up from the store, as are groups whose member map has changed,
which start anew.

Tables of a refresh are a version of their own beside the documents (``dashboard/v=<batch>``).
The store's pointer is moved when both are written: readers see documents and dashboard of
the same batch, a failed refresh leaves both as they were, and a replayed batch writes the
same version again.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from potluck.operators import aggregates as A
from potluck.operators.tables import first_rows, raw_table
from potluck.operators.widen import widen
from potluck.plans.ledger import Ledger, LedgerParams
from potluck.plans.snapshot import Snapshot
from potluck.schemas import RECENT_ROWS_DEFAULT, RECENT_ROWS_MIN, SUM
from potluck.sinks import writers
from potluck.sources.docs import ledger_from_docs, marked_shares

G = "group_id"
SPARE = 70                       # newest rows kept beyond those that are shown
KEYS = {"sums": [G, "month", "category", "currency"], "member_sums": [G, "month", "member", "kept"]}
VALUES = {"sums": "amount", "member_sums": "v"}
SETTINGS = "settings"


@dataclass(frozen=True)
class Dashboard:
    """What a refresh builds: ``groups`` and ``debts`` are read anew each time."""
    groups: Callable[[SparkSession], DataFrame]
    debts: Callable[[SparkSession], DataFrame]
    params: LedgerParams = field(default_factory=LedgerParams)
    recent_rows: int = RECENT_ROWS_DEFAULT
    generated_at: Callable[[], str | None] = lambda: None

    @property
    def shown(self) -> int:
        return max(self.recent_rows, RECENT_ROWS_MIN)

    def settings(self) -> str:
        """What the sums depend on beside documents and members."""
        return json.dumps([repr(self.params), self.shown])

    def ledger(self, docs: DataFrame, groups: DataFrame) -> Ledger:
        return ledger_from_docs(docs, groups, self.debts(docs.sparkSession), self.params, latest=True)


def contributions(led: Ledger, docs: DataFrame | None = None) -> dict[str, DataFrame]:
    """The sums that a ledger's documents make. With the documents, the member sums take from
    them which shares are kept; exclusions need the table of expenses for that."""
    if docs is None or led.params.exclusions.active:
        people = A.member_base(led.expenses, led.shares, led.members, led.params.share_mode)
    else:
        people = A.marked_member_base(marked_shares(docs, led.members), led.members, led.params.share_mode)
    return {"sums": A.chart_base(led.expenses), "member_sums": people}


def _advanced(name: str, state: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    keys, value = KEYS[name], VALUES[name]
    minus = before.select(*keys, (-F.col(value)).cast(SUM).alias(value), (-F.col("n")).alias("n"))
    plus = [df.select(*keys, F.col(value).cast(SUM).alias(value), "n") for df in (state, after)]
    both = plus[0].unionByName(minus).unionByName(plus[1])
    return both.groupBy(*keys).agg(F.sum(value).cast(SUM).alias(value), F.sum("n").alias("n")).where("n <> 0")


def _newest(led: Ledger, n: int, write: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """The first ``n`` rows of each group; member amounts are gathered for these alone. With
    ``write`` the rows are written first, so that the shares meet a table whose size is known."""
    top = write(first_rows(led.expenses, n).drop("pos"))
    shares = led.shares.join(top.select(G, "expense_id"), [G, "expense_id"], "left_semi")
    return raw_table(widen(top, shares, led.members, A.net_owes(led.params.share_mode)))


def _cut(rows: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows of each group with the place of the last one (``cut``) where there
    are as many; else ``cut`` stays as it is. Rows behind a cut are not known here."""
    top = first_rows(rows, n)
    last = top.where(F.col("pos") == n - 1).select(F.col(G).alias("_g"), F.struct("date", "expense_id").alias("_cut"))
    return top.join(last, F.col(G).eqNullSafe(F.col("_g")), "left").withColumn(
        "cut", F.coalesce("_cut", "cut")).drop("_g", "_cut")


def _filled(led: Ledger, n: int, write: Callable[[DataFrame], DataFrame]) -> DataFrame:
    return _cut(_newest(led, n, write).withColumn("cut", F.lit(None).cast("struct<date:string,expense_id:bigint>")), n)


def _apart(df: DataFrame, groups: DataFrame, how: str) -> DataFrame:
    """Rows of the ``groups`` (left_semi), or of all others (left_anti); null is a group."""
    of = groups.select(F.col(G).alias("_g"))
    return df.join(of, F.col(G).eqNullSafe(F.col("_g")), how)


def refresh(spark: SparkSession, root: str, version: int, previous: int | None, dashboard: Dashboard,
            old: DataFrame, new: DataFrame, everything: Callable[[], DataFrame]) -> None:
    """Write the dashboard of a batch under ``root``.

    ``old`` and ``new``: the touched documents before and after the batch; ``everything``: all
    documents after it, read only where a group has to start anew or be filled up. Each of them
    holds one document of a key."""
    groups = dashboard.groups(spark)
    base = writers.version_path(root, version)
    writers.begin(spark, root, version)

    def written(name: str, df: DataFrame) -> DataFrame:
        writers.write_table(df, f"{base}/{name}")
        return writers.read_table(spark, f"{base}/{name}", df.schema)

    after = dashboard.ledger(new, groups)
    members = written("members", after.members)
    keep = dashboard.shown + SPARE
    state = _state(spark, root, previous, dashboard)
    if state is None:
        docs = everything()
        led = dashboard.ledger(docs, groups)
        tables = {name: written(name, df) for name, df in contributions(led, docs).items()}
        recent = written("recent", _filled(led, keep, lambda df: written("top", df)))
    else:
        # groups with another member map than before
        moved = members.exceptAll(state["members"]).unionByName(state["members"].exceptAll(members)).select(G).distinct()
        moved = written("moved", moved)
        anew = moved.limit(1).count() > 0
        before = dashboard.ledger(old, groups)
        again = _apart(everything(), moved, "left_semi") if anew else None
        fresh = contributions(dashboard.ledger(again, groups), again) if anew else None
        minus, plus, tables = contributions(before, old), contributions(after, new), {}
        for name in KEYS:
            rest = [_apart(df, moved, "left_anti") if anew else df for df in (state[name], minus[name], plus[name])]
            total = _advanced(name, *rest)
            tables[name] = written(name, total.unionByName(fresh[name].select(total.columns)) if anew else total)
        recent = _recent(dashboard, state["recent"], old, after, moved, keep, written, everything, groups)
    snap = _snapshot(dashboard, after, members, tables, recent)
    writers.publish(spark, root, version, {
        SETTINGS: spark.createDataFrame([(dashboard.settings(),)], "value string"), "snapshot": snap.to_json(),
        "monthly_by_category": snap.monthly_by_category(), "per_person_month": snap.per_person_month()},
        keep=("members", "sums", "member_sums", "recent", "moved", "carried"))


def _state(spark: SparkSession, root: str, previous: int | None, dashboard: Dashboard) -> dict[str, DataFrame] | None:
    """The tables of the batch before; None where they are missing or were made otherwise."""
    if previous is None or previous not in writers.list_versions(spark, root):
        return None
    base = writers.version_path(root, previous)
    if spark.read.parquet(f"{base}/{SETTINGS}").first()[0] != dashboard.settings():
        return None
    return {name: spark.read.parquet(f"{base}/{name}") for name in (*KEYS, "members", "recent")}


def _recent(dashboard: Dashboard, kept: DataFrame, old: DataFrame, after: Ledger, moved: DataFrame, keep: int,
            written: Callable[[str, DataFrame], DataFrame], everything: Callable[[], DataFrame], groups: DataFrame) -> DataFrame:
    """The newest rows after a batch."""
    touched = old.select(F.col(G).alias("_g"), F.col("id").alias("_i")).distinct()
    rest = kept.drop("pos", "cut").join(
        touched, F.col(G).eqNullSafe(F.col("_g")) & F.col("expense_id").eqNullSafe(F.col("_i")), "left_anti")
    cuts = kept.select(F.col(G).alias("_of"), "cut").distinct()
    newest = _newest(after, keep, lambda df: written("top", df))
    rows = rest.unionByName(newest).join(cuts, F.col(G).eqNullSafe(F.col("_of")), "left").drop("_of")
    # what does not stand behind the cut is complete
    known = F.col("cut").isNull() | (F.col("date") > F.col("cut.date")) | (F.col("date").eqNullSafe(F.col("cut.date")) & (
        F.col("expense_id").isNull() | (F.col("expense_id") <= F.col("cut.expense_id"))))
    carried = written("carried", _cut(rows.where(F.coalesce(known, F.lit(False))), keep))
    left = carried.groupBy(F.col(G).alias("_g")).agg(F.count("*").alias("n"))
    short = (cuts.where("cut is not null").join(left, F.col("_of").eqNullSafe(F.col("_g")), "left")
             .where(F.coalesce("n", F.lit(0)) < dashboard.shown).select(F.col("_of").alias(G)))
    again = short.unionByName(moved).distinct()
    if again.limit(1).count() == 0:
        return written("recent", carried)
    filled = _filled(dashboard.ledger(_apart(everything(), again, "left_semi"), groups), keep, lambda df: written("filled", df))
    return written("recent", _apart(carried, again, "left_anti").unionByName(filled.select(carried.columns)))


def _snapshot(dashboard: Dashboard, led: Ledger, members: DataFrame, tables: dict[str, DataFrame], recent: DataFrame) -> Snapshot:
    """The snapshot whose base tables are those of the refresh."""
    snap = Snapshot(led, dashboard.shown, dashboard.generated_at())
    sums, people = tables["sums"], tables["member_sums"]
    months = sums.select(G, "month", F.lit(None).cast("string").alias("member"), F.lit(None).cast(SUM).alias("v")).distinct()
    kept = people.where("kept").select(G, "month", "member", "v")
    by_member = people.groupBy(G, "month", "member").agg(F.sum("v").cast(SUM).alias("v"))
    snap.__dict__.update(
        sums=sums, raw_wide=recent.drop("pos", "cut"), person_month=A.person_month_grid(by_member, members),
        owes_by_month=A.person_totals_grid(months.unionByName(kept), members))
    return snap


def published(spark: SparkSession, root: str, version: int | None, name: str = "snapshot") -> DataFrame | None:
    """A table of the dashboard of a batch, the JSON documents by default."""
    return None if version is None else writers.read_published(spark, root, name, version=version)
