"""potluck — shared-expense ledger analytics as Spark jobs over many groups.

Entry points:

* ``potluck.sources.docs`` — read landed documents, group configs and debts, build a ledger;
* ``potluck.plans.ledger`` — the lazy ledger tables (``Ledger``, ``LedgerParams``);
* ``potluck.operators`` — normalization, exclusions, upsert, aggregates, trends, debts, bars, tables;
* ``potluck.plans.export`` / ``plans.snapshot`` / ``plans.views`` — the batch export, the
  dashboard refresh and its views;
* ``potluck.streaming.upsert_stream`` — the Structured Streaming refresh;
* ``potluck.cli`` — ``export`` / ``snapshot`` / ``stream`` commands.
"""

__version__ = "0.1.0"
