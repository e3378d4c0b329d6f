"""Command line: the batch export, the dashboard refresh and the streaming refresh.

    python -m potluck.cli export   --docs D --groups G [--debts X] --out ROOT [--start YYYY-MM]
                                   [--end YYYY-MM] [--group-id N ...] [--no-raw-shares] [--debug-shares]
    python -m potluck.cli snapshot --docs D --groups G [--debts X] --out ROOT [--recent N]
    python -m potluck.cli stream   --landing L --store S --checkpoint C [--interval SEC | --once]

Options that the single-group original reads from its environment are flags here:
``--exclude-months``, ``--exclude-descriptions``, ``--debt-direction``,
``--share-direction``. Inputs are JSON lines unless ``--format parquet``.
"""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="potluck")
    sub = p.add_subparsers(dest="cmd", required=True)

    def inputs(sp):
        sp.add_argument("--docs", required=True)
        sp.add_argument("--groups", required=True)
        sp.add_argument("--debts")
        sp.add_argument("--format", default="json", choices=["json", "parquet"])
        sp.add_argument("--out", required=True, help="root folder of the published versions")
        sp.add_argument("--version", type=int, default=None, help="version id (default: epoch seconds)")
        sp.add_argument("--start", help="first month, YYYY-MM")
        sp.add_argument("--end", help="last month, YYYY-MM")
        sp.add_argument("--group-id", type=int, nargs="*", default=None)
        rules(sp)

    def rules(sp):
        sp.add_argument("--exclude-months", default="")
        sp.add_argument("--exclude-descriptions", default="")
        sp.add_argument("--debt-direction", default="reverse")
        sp.add_argument("--share-direction", default=None)

    e = sub.add_parser("export", help="upsert into the store and publish the export tables")
    inputs(e)
    e.add_argument("--no-raw-shares", action="store_true")
    e.add_argument("--debug-shares", action="store_true")
    e.add_argument("--report-format", default="parquet", choices=["parquet", "csv"])

    s = sub.add_parser("snapshot", help="publish dashboard documents and tables")
    inputs(s)
    s.add_argument("--recent", type=int, default=30)

    st = sub.add_parser("stream", help="refresh the store from a landing folder")
    st.add_argument("--landing", required=True)
    st.add_argument("--store", required=True)
    st.add_argument("--checkpoint", required=True)
    st.add_argument("--format", default="parquet", choices=["json", "parquet"])
    st.add_argument("--interval", default=None)
    st.add_argument("--once", action="store_true", help="process what has landed, then stop")
    st.add_argument("--groups", help="group configuration; with it each refresh publishes the dashboard")
    st.add_argument("--debts")
    st.add_argument("--recent", type=int, default=30)
    rules(st)
    return p


def _params(a):
    from potluck.operators.exclusions import ExclusionRules
    from potluck.plans.ledger import LedgerParams
    return LedgerParams(a.debt_direction, a.share_direction, ExclusionRules.of(a.exclude_months, a.exclude_descriptions))


def _now() -> str:
    return time.strftime("%Y-%m-%dT%H:%M:%S+00:00", time.gmtime())


def _dashboard(a):
    """What a refresh of the stream builds; nothing without the groups."""
    from potluck.sources.docs import read_debts, read_groups
    from potluck.streaming.dashboard import Dashboard
    if not a.groups:
        return None
    return Dashboard(lambda spark: read_groups(spark, a.groups, a.format), lambda spark: read_debts(spark, a.debts, a.format),
                     _params(a), a.recent, _now)


def _ledger(spark: SparkSession, a):
    from potluck.sources.docs import ledger_from_docs, read_debts, read_docs, read_groups, rejected_docs
    docs = read_docs(spark, a.docs, a.format)
    if a.format == "json" and (bad := rejected_docs(spark, a.docs).count()):
        print(f"[!] {bad} line(s) of {a.docs} are no documents and are left out", file=sys.stderr)
    return ledger_from_docs(docs, read_groups(spark, a.groups, a.format), read_debts(spark, a.debts, a.format),
                            _params(a), a.group_id, a.start, a.end)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = _parser().parse_args(argv)
    if spark is None:
        from potluck.session import SKEW_SETTINGS
        spark = SparkSession.builder.appName(f"potluck-{a.cmd}").config(map=SKEW_SETTINGS).getOrCreate()
    if a.cmd == "stream":
        from potluck.streaming.upsert_stream import start
        q = start(spark, a.landing, a.store, a.checkpoint, a.interval, a.once, a.format, dashboard=_dashboard(a))
        q.awaitTermination()
        return 0
    led = _ledger(spark, a)
    version = a.version if a.version is not None else int(time.time())
    if a.cmd == "export":
        from potluck.operators import aggregates as A
        from potluck.plans.export import export
        from potluck.schemas import EXPENSE_STORE
        from potluck.sinks import writers
        res = export(spark, led, a.out, version, include_shares=not a.no_raw_shares,
                     report_format=a.report_format)
        if a.debug_shares:
            # bounded console output: overall counts and the first six rows
            tot = led.shares.agg(F.count(F.lit(1)).alias("share_rows"),
                                 F.count_distinct("group_id", "expense_id").alias("distinct_expenses")).first()
            print(json.dumps(tot.asDict()))
            for r in led.shares.orderBy("group_id", "expense_id", "user_id").limit(6).collect():
                print(json.dumps({k: str(v) for k, v in r.asDict().items()}))
        # the merged table, stored rows included, as it was written
        merged = writers.read_published(spark, a.out, "raw_expenses", EXPENSE_STORE, version=version)
        first = A.multi_currency(merged).where("multi_currency").orderBy("group_id").limit(21).collect()
        if first:
            n_warn, some = ("over 20" if len(first) > 20 else len(first)), [r.group_id for r in first[:20]]
            print(f"[!] {n_warn} group(s) with more than one currency (amounts are not converted), "
                  f"e.g. {some}", file=sys.stderr)
        print(json.dumps({"path": res.path, "version": res.version, "tables": list(res.tables)}))
        return 0
    from potluck.plans.snapshot import Snapshot
    from potluck.sinks import writers
    snap = Snapshot(led, recent_rows=a.recent, start_month=a.start, end_month=a.end,
                    generated_at=_now())
    base = f"{a.out.rstrip('/')}/_base"
    snap = snap.materialize(base, version)
    # the wide expense table is already written once under the base version; only the
    # documents and the small pivots are published here
    writers.publish(spark, a.out, version, {
        "snapshot": snap.to_json(), "monthly_by_category": snap.monthly_by_category(),
        "per_person_month": snap.per_person_month()})
    print(json.dumps({"path": writers.version_path(a.out, version), "version": version,
                      "raw_expenses": f"{writers.version_path(base, version)}/raw_wide"}))
    return 0


if __name__ == "__main__":
    sys.exit(main())
