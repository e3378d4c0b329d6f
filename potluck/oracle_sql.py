"""DuckDB SQL twin of every registered query (the correctness oracle).

The driver registers the raw tables as views; the common table expressions below map them
to the ledger exactly as ``potluck.sources.fixture`` does, in plain SQL. Each query
repeats the ledger semantics independently of the Spark code.
"""

from __future__ import annotations

BASE_CTES = """
hdr AS (
  SELECT CAST(c.c_nationkey AS BIGINT) AS group_id, o.o_orderkey AS id,
         substring(CAST(o.o_orderdate AS VARCHAR), 1, 10) AS date,
         CAST(o.o_orderdate AS VARCHAR) AS updated_at,
         CASE WHEN o.o_orderkey % 23 = 0 THEN '2002-01-01' END AS deleted_at,
         CAST(o.o_totalprice AS DECIMAL(18,2)) AS amount,
         CASE WHEN o.o_orderkey % 50 = 0 THEN 'USD' ELSE 'ILS' END AS currency,
         o.o_orderpriority || ' ' || c.c_mktsegment AS description,
         CASE WHEN o.o_orderkey % 20 = 0 THEN 'Payment'
              WHEN o.o_orderkey % 31 = 0 THEN 'Bank Transfer'
              WHEN o.o_orderkey % 17 = 0 THEN NULL
              ELSE c.c_mktsegment END AS category_name
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey),
members AS (
  SELECT CAST(n_nationkey AS BIGINT) AS group_id, CAST(1 + (n_nationkey + d) % 7 AS BIGINT) AS user_id,
         CASE WHEN d = 0 THEN 'Alice' ELSE n_name || ' ' || d END AS name, CAST(o AS INTEGER) AS ord
  FROM nation, (VALUES (0, 1), (4, 2), (2, 3)) AS t(d, o)
  UNION ALL
  SELECT CAST(n_nationkey AS BIGINT), CAST(100 + i AS BIGINT), n_name || ' ' || (100 + i), CAST(3 + i AS INTEGER)
  FROM nation, range(1, 43) AS r(i)),
member_names AS (SELECT group_id, name AS member, MIN(ord) AS ord FROM members GROUP BY 1, 2),
all_expenses AS (
  SELECT group_id, id AS expense_id, date, updated_at, substring(date, 1, 7) AS month,
         description, coalesce(category_name, 'Uncategorized') AS category, amount, currency
  FROM hdr WHERE deleted_at IS NULL),
expenses AS (
  SELECT * FROM all_expenses WHERE NOT regexp_matches(lower(category), 'payment|transfer')),
share_src AS (
  SELECT h.group_id, l.l_orderkey AS expense_id, CAST(l.l_linenumber AS BIGINT) AS user_id,
         substring(h.date, 1, 7) AS month,
         CAST(l.l_extendedprice AS DECIMAL(18,2)) AS owed_share,
         CASE l.l_returnflag WHEN 'A' THEN CAST(0 AS DECIMAL(18,2))
              WHEN 'N' THEN CAST(2 * CAST(l.l_extendedprice AS DECIMAL(18,2)) AS DECIMAL(18,2))
              ELSE CAST(l.l_extendedprice AS DECIMAL(18,2)) END AS paid_share
  FROM lineitem l JOIN hdr h ON l.l_orderkey = h.id
  WHERE h.deleted_at IS NULL),
shares AS (
  SELECT s.group_id, s.expense_id, s.user_id,
         coalesce(m.name, CAST(s.user_id AS VARCHAR)) AS person, s.month, s.owed_share, s.paid_share
  FROM share_src s LEFT JOIN members m ON m.group_id = s.group_id AND m.user_id = s.user_id),
tracked AS (
  SELECT s.*, m.name AS member, m.ord,
         greatest(s.paid_share - s.owed_share, 0) AS net_rev,
         greatest(s.owed_share - s.paid_share, 0) AS net_norm
  FROM shares s JOIN members m ON m.group_id = s.group_id AND m.user_id = s.user_id),
debt_sums AS (
  SELECT CAST(c.c_nationkey AS BIGINT) AS group_id, CAST(l.l_linenumber AS BIGINT) AS f,
         CAST(l.l_suppkey % 7 + 1 AS BIGINT) AS t,
         SUM(CAST(l.l_extendedprice AS DECIMAL(18,2))) AS amount
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
       JOIN customer c ON o.o_custkey = c.c_custkey
  WHERE l.l_linenumber <> l.l_suppkey % 7 + 1
  GROUP BY 1, 2, 3)"""


def sql(select: str, extra: str = "") -> str:
    """``WITH <base>[, extra] <select>``; ``extra`` holds more CTEs (no leading comma)."""
    ctes = BASE_CTES + (",\n" + extra if extra else "")
    return f"WITH {ctes}\n{select}"


QUERIES: dict[str, str] = {}


def register(name: str, select: str, extra: str = "") -> None:
    QUERIES[name] = sql(select, extra)


# ------------------------------------------------------------------ expense aggregates
register("month_category", """
SELECT group_id, month, category, CAST(SUM(amount) AS DOUBLE) AS amount
FROM expenses GROUP BY 1, 2, 3""")

register("month_category_pivot", """
SELECT m.group_id, m.month, c.category, CAST(coalesce(s.v, 0) AS DOUBLE) AS amount, CAST(m.t AS DOUBLE) AS total
FROM (SELECT group_id, month, SUM(amount) AS t FROM expenses GROUP BY 1, 2) m
JOIN (SELECT DISTINCT group_id, category FROM expenses) c ON c.group_id = m.group_id
LEFT JOIN (SELECT group_id, month, category, SUM(amount) AS v FROM expenses GROUP BY 1, 2, 3) s
  ON s.group_id = m.group_id AND s.month = m.month AND s.category = c.category""")

register("monthly_totals", """
SELECT group_id, month, CAST(SUM(amount) AS DOUBLE) AS amount FROM expenses GROUP BY 1, 2""")

register("category_totals", """
SELECT group_id, category, CAST(SUM(amount) AS DOUBLE) AS amount
FROM expenses GROUP BY 1, 2 HAVING SUM(amount) > 0""")

register("category_by_month", """
SELECT group_id, month, category, CAST(SUM(amount) AS DOUBLE) AS amount
FROM expenses GROUP BY 1, 2, 3 HAVING SUM(amount) > 0""")

register("category_cube", """
SELECT group_id, CASE WHEN GROUPING(month) = 1 THEN 'All months' ELSE month END AS month,
       category, CAST(SUM(amount) AS DOUBLE) AS amount
FROM expenses GROUP BY GROUPING SETS ((group_id, category), (group_id, month, category))""")

register("category_series", """
SELECT group_id, category, month, CAST(amount AS DOUBLE) AS amount,
       row_number() OVER (PARTITION BY group_id, category ORDER BY month DESC) - 1 AS pos
FROM (SELECT group_id, category, month, SUM(amount) AS amount FROM expenses
      GROUP BY 1, 2, 3 HAVING SUM(amount) > 0)""")

register("summary", """
SELECT group_id, COUNT(*) AS expense_count, CAST(SUM(amount) AS DOUBLE) AS total_expenses,
       array_to_string(list_sort(list_distinct(list(currency) FILTER (WHERE trim(currency) <> ''))), ',')
         AS currencies
FROM expenses GROUP BY 1""")

register("multi_currency", """
SELECT group_id, COUNT(DISTINCT currency) AS currency_count, COUNT(DISTINCT currency) > 1 AS multi_currency
FROM expenses GROUP BY 1""")

register("distinct_values", """
SELECT DISTINCT group_id, 'currency' AS kind, currency AS value FROM expenses WHERE trim(currency) <> ''
UNION ALL
SELECT DISTINCT group_id, 'month' AS kind, month AS value FROM expenses WHERE trim(month) <> ''
UNION ALL
SELECT group_id, 'category' AS kind, category AS value FROM expenses GROUP BY 1, 3 HAVING SUM(amount) > 0""")

register("scoped_month", """
SELECT group_id,
       CASE WHEN m_count > 0 THEN '1997-06' ELSE 'all' END AS selected_month,
       CASE WHEN m_count > 0 THEN m_count ELSE all_count END AS scoped_count,
       CAST(CASE WHEN m_count > 0 THEN coalesce(m_total, 0) ELSE all_total END AS DOUBLE) AS scoped_total
FROM (SELECT group_id, COUNT(*) AS all_count, SUM(amount) AS all_total,
             COUNT(*) FILTER (WHERE month = '1997-06') AS m_count,
             SUM(amount) FILTER (WHERE month = '1997-06') AS m_total
      FROM expenses GROUP BY 1)""")

EXPENSE_COLS = ("group_id, expense_id, date, updated_at, month, description, category, "
                "CAST(amount AS DOUBLE) AS amount, currency")

register("normalize_expenses", f"SELECT {EXPENSE_COLS} FROM expenses")

register("scan_month_range", f"""
SELECT {EXPENSE_COLS} FROM expenses WHERE date >= '1996-01-01' AND date < '1998-01-01'""")

# ------------------------------------------------------------------ shares
register("explode_shares", """
SELECT group_id, expense_id, user_id, person, month,
       CAST(owed_share AS DOUBLE) AS owed_share, CAST(paid_share AS DOUBLE) AS paid_share
FROM shares""")

register("person_names", "SELECT DISTINCT group_id, user_id, person FROM shares")

register("net_owes_rows", """
SELECT group_id, expense_id, user_id, member AS person, month, CAST(net_rev AS DOUBLE) AS net_owes
FROM tracked""")

PERSON_MONTH = """
SELECT m.group_id, m.month, p.member AS person, false AS is_total, CAST(coalesce(s.v, 0) AS DOUBLE) AS amount
FROM pm_months m JOIN pm_persons p ON p.group_id = m.group_id
LEFT JOIN pm_sums s ON s.group_id = m.group_id AND s.month = m.month AND s.member = p.member
UNION ALL
SELECT group_id, month, 'Total' AS person, true AS is_total, CAST(SUM(v) AS DOUBLE) AS amount FROM pm_sums GROUP BY 1, 2"""


def _person_month_ctes(value: str, where: str = "true") -> str:
    return f"""
pm_sums AS (SELECT group_id, month, member, SUM({value}) AS v FROM tracked WHERE {where} GROUP BY 1, 2, 3),
pm_months AS (SELECT DISTINCT group_id, month FROM pm_sums),
pm_persons AS (SELECT DISTINCT group_id, member FROM pm_sums)"""


register("person_month_owed", PERSON_MONTH, _person_month_ctes("owed_share"))
register("person_month_net", PERSON_MONTH, _person_month_ctes("net_rev"))


def pyfloat_sql(c: str) -> str:
    return f"regexp_replace(CAST(CAST({c} AS DECIMAL(38,2)) AS VARCHAR), '0$', '')"


def _wide_ctes(value: str) -> str:
    """``wide``: expenses with the members' amounts as text, as numbers only, as money and JSON."""
    v = "round(coalesce(s.v, 0), 2)"
    return f"""
share_sums AS (SELECT group_id, expense_id, member, SUM({value}) AS v FROM tracked GROUP BY 1, 2, 3),
member_cells AS (
  SELECT e.group_id, e.expense_id,
         string_agg(m.member || '=' || {pyfloat_sql(v)}, ', ' ORDER BY m.ord) AS owes,
         string_agg({pyfloat_sql(v)}, ' ' ORDER BY m.ord) AS amounts,
         string_agg(m.member || ' ' || '₪' || format('{{:,.2f}}', CAST({v} AS DOUBLE)), '; ' ORDER BY m.ord) AS money,
         string_agg('"' || m.member || '_owes":' || CAST(to_json(CAST({v} AS DOUBLE)) AS VARCHAR), ',' ORDER BY m.ord) AS json
  FROM expenses e JOIN member_names m ON m.group_id = e.group_id
  LEFT JOIN share_sums s ON s.group_id = e.group_id AND s.expense_id = e.expense_id AND s.member = m.member
  GROUP BY 1, 2),
wide AS (SELECT e.*, c.owes, c.amounts, c.money, c.json
         FROM expenses e LEFT JOIN member_cells c ON c.group_id = e.group_id AND c.expense_id = e.expense_id)"""


WIDE_SELECT = f"SELECT {EXPENSE_COLS}, owes FROM wide"

register("widen_owes", WIDE_SELECT, _wide_ctes("owed_share"))
register("widen_net_owes", WIDE_SELECT, _wide_ctes("net_rev"))

KEPT_TRACKED = """
kept_tracked AS (
  SELECT t.* FROM tracked t
  WHERE EXISTS (SELECT 1 FROM expenses e WHERE e.group_id = t.group_id AND e.expense_id = t.expense_id))"""

register("person_totals", """
SELECT n.group_id, n.member AS person, CAST(coalesce(s.v, 0) AS DOUBLE) AS amount
FROM member_names n
LEFT JOIN (SELECT group_id, member, SUM(net_rev) AS v FROM kept_tracked GROUP BY 1, 2) s
  ON s.group_id = n.group_id AND s.member = n.member""", KEPT_TRACKED)

register("person_totals_by_month", """
SELECT m.group_id, m.month, n.member AS person, CAST(coalesce(s.v, 0) AS DOUBLE) AS amount
FROM (SELECT DISTINCT group_id, month FROM expenses) m
JOIN member_names n ON n.group_id = m.group_id
LEFT JOIN (SELECT group_id, month, member, SUM(net_rev) AS v FROM kept_tracked GROUP BY 1, 2, 3) s
  ON s.group_id = m.group_id AND s.month = m.month AND s.member = n.member""", KEPT_TRACKED)

register("share_sanity", """
SELECT group_id, COUNT(*) AS share_rows, COUNT(DISTINCT expense_id) AS distinct_expenses
FROM shares GROUP BY 1""")

register("share_sample", """
SELECT group_id, expense_id, user_id, person, month,
       CAST(owed_share AS DOUBLE) AS owed_share, CAST(paid_share AS DOUBLE) AS paid_share
FROM (SELECT *, row_number() OVER (PARTITION BY group_id
                                   ORDER BY expense_id, user_id, owed_share, paid_share) AS rn
      FROM shares)
WHERE rn <= 6""")

register("top_people", """
SELECT group_id, rnk AS rank, member AS person, CAST(v AS DOUBLE) AS amount
FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY v DESC, ord DESC) AS rnk
      FROM (SELECT group_id, member, MIN(ord) AS ord, SUM(owed_share) AS v FROM tracked GROUP BY 1, 2))
WHERE rnk <= 2""")

# ------------------------------------------------------------------ calendar
CALENDAR = """
calendar AS (
  SELECT group_id, strftime(d, '%Y-%m') AS month, d
  FROM (SELECT group_id, unnest(generate_series(CAST(min(month) || '-01' AS DATE),
                                                 CAST(max(month) || '-01' AS DATE), INTERVAL 1 MONTH)) AS d
        FROM expenses WHERE regexp_matches(month, '^[0-9]{4}-[0-9]{2}$') GROUP BY group_id))"""

register("month_calendar", "SELECT group_id, month FROM calendar", CALENDAR)

register("month_bounds", """
SELECT group_id, month, strftime(d, '%Y-%m-%d') AS start_date,
       strftime(CAST(d + INTERVAL 1 MONTH AS DATE), '%Y-%m-%d') AS end_date
FROM calendar""", CALENDAR)

# ------------------------------------------------------------------ exclusions, upsert
KEPT = """
kept AS (
  SELECT * FROM expenses
  WHERE NOT (month IN ('1996-03', '1997-06', '1998-01')
             AND contains(lower(description), 'urgent') AND contains(lower(description), 'building')))"""

register("exclusions", """
SELECT s.group_id, s.expense_id, s.user_id, s.person, s.month,
       CAST(s.owed_share AS DOUBLE) AS owed_share, CAST(s.paid_share AS DOUBLE) AS paid_share
FROM shares s
WHERE EXISTS (SELECT 1 FROM kept k WHERE k.group_id = s.group_id AND k.expense_id = s.expense_id)""", KEPT)

register("exclusion_counts", """
SELECT e.group_id, e.expenses_before, e.expenses_after, s.shares_before, s.shares_after,
       e.expenses_before - e.expenses_after AS expenses_removed,
       s.shares_before - s.shares_after AS shares_removed
FROM (SELECT group_id, COUNT(*) AS expenses_before,
             COUNT(*) FILTER (WHERE expense_id IN (SELECT expense_id FROM kept)) AS expenses_after
      FROM expenses GROUP BY 1) e
JOIN (SELECT group_id, COUNT(*) AS shares_before,
             COUNT(*) FILTER (WHERE expense_id IN (SELECT expense_id FROM kept)) AS shares_after
      FROM shares GROUP BY 1) s ON s.group_id = e.group_id""", KEPT)

STORE = _wide_ctes("owed_share") + """,
store AS (
  SELECT group_id, CASE WHEN expense_id % 3 = 2 THEN -expense_id ELSE expense_id END AS expense_id, date, updated_at,
         month, 'old ' || description AS description, category, CAST(amount AS DOUBLE) AS amount, currency, owes
  FROM wide),
incoming AS (SELECT * FROM expenses)"""

register("legacy_owes_columns", "SELECT * FROM store", STORE)

register("upsert_expenses", """
SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY date, category, description, expense_id) - 1 AS pos
FROM (SELECT coalesce(i.group_id, s.group_id) AS group_id, coalesce(i.expense_id, s.expense_id) AS expense_id,
       coalesce(i.date, s.date) AS date, coalesce(i.updated_at, s.updated_at) AS updated_at,
       coalesce(i.month, s.month) AS month, coalesce(i.description, s.description) AS description,
       coalesce(i.category, s.category) AS category,
       coalesce(CAST(i.amount AS DOUBLE), s.amount) AS amount, coalesce(i.currency, s.currency) AS currency, s.owes
FROM store s FULL OUTER JOIN incoming i ON i.group_id = s.group_id AND i.expense_id = s.expense_id)""", STORE)

register("new_expenses", f"""
SELECT {EXPENSE_COLS} FROM incoming i
WHERE NOT EXISTS (SELECT 1 FROM store s WHERE s.group_id = i.group_id AND s.expense_id = i.expense_id)""",
         STORE)

# ------------------------------------------------------------------ trends
MOM = """
mc AS (SELECT group_id, month, category, false AS is_total, SUM(amount) AS v FROM expenses GROUP BY 1, 2, 3
       UNION ALL SELECT group_id, month, 'Total', true, SUM(amount) AS v FROM expenses GROUP BY 1, 2),
grid AS (SELECT m.group_id, m.month, c.category, c.is_total
         FROM (SELECT DISTINCT group_id, month FROM mc) m
         JOIN (SELECT DISTINCT group_id, category, is_total FROM mc) c ON c.group_id = m.group_id),
cells AS (SELECT g.group_id, g.month, g.category, g.is_total, coalesce(mc.v, 0) AS v
          FROM grid g LEFT JOIN mc ON mc.group_id = g.group_id AND mc.month = g.month
                                   AND mc.category = g.category AND mc.is_total = g.is_total),
lagged AS (SELECT *, lag(v) OVER (PARTITION BY group_id, category, is_total ORDER BY month) AS prev FROM cells),
mom AS (SELECT group_id, month, category, is_total, CAST(v AS DOUBLE) AS value, CAST(v - prev AS DOUBLE) AS delta,
               CASE WHEN prev IS NULL OR prev = 0 THEN 0.0
                    ELSE CAST(v AS DOUBLE) / CAST(prev AS DOUBLE) - 1 END AS pct
        FROM lagged)"""

register("mom_full", "SELECT * FROM mom", MOM)
register("mom_delta", "SELECT group_id, month, category, is_total, delta FROM mom", MOM)
register("mom_pct", "SELECT group_id, month, category, is_total, pct FROM mom", MOM)

# ------------------------------------------------------------------ debts
EDGES = """
edges AS (
  SELECT d.group_id, d.t AS from_id, d.f AS to_id,
         row_number() OVER (PARTITION BY d.group_id ORDER BY d.amount DESC, d.t, d.f) - 1 AS pos,
         coalesce(mf.name, CAST(d.t AS VARCHAR)) AS from_name,
         coalesce(mt.name, CAST(d.f AS VARCHAR)) AS to_name, d.amount
  FROM debt_sums d
  LEFT JOIN members mf ON mf.group_id = d.group_id AND mf.user_id = d.t
  LEFT JOIN members mt ON mt.group_id = d.group_id AND mt.user_id = d.f
  WHERE d.amount > 0)"""

register("debt_edges", """
SELECT group_id, from_id, to_id, from_name, to_name, CAST(amount AS DOUBLE) AS amount, pos FROM edges""", EDGES)

register("member_balances", """
SELECT n.group_id, n.member AS name, CAST(coalesce(o.v, 0) AS DOUBLE) AS owes,
       CAST(coalesce(r.v, 0) AS DOUBLE) AS to_receive
FROM member_names n
LEFT JOIN (SELECT group_id, from_name AS nm, SUM(amount) AS v FROM edges GROUP BY 1, 2) o
  ON o.group_id = n.group_id AND o.nm = n.member
LEFT JOIN (SELECT group_id, to_name AS nm, SUM(amount) AS v FROM edges GROUP BY 1, 2) r
  ON r.group_id = n.group_id AND r.nm = n.member""", EDGES)

register("debtor_totals", """
SELECT n.group_id, n.member AS person, CAST(coalesce(s.v, 0) AS DOUBLE) AS amount
FROM member_names n
LEFT JOIN (SELECT d.group_id, m.name, SUM(d.amount) AS v FROM debt_sums d
           JOIN members m ON m.group_id = d.group_id AND m.user_id = d.f GROUP BY 1, 2) s
  ON s.group_id = n.group_id AND s.name = n.member""", EDGES)

register("top_debt", """
SELECT group_id, from_id, to_id, from_name, to_name, CAST(amount AS DOUBLE) AS amount
FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY amount DESC, from_id, to_id) AS rn FROM edges)
WHERE rn = 1""", EDGES)

# ------------------------------------------------------------------ charts, tables, formats


def color_sql(c: str) -> str:
    def part(start: int, length: int) -> str:
        return f"CAST('0x' || substring(sha256(coalesce(nullif({c}, ''), 'unknown')), {start}, {length}) AS BIGINT)"
    return (f"('hsl(' || CAST({part(1, 8)} % 360 AS VARCHAR) || 'deg ' || CAST(62 + {part(9, 2)} % 24 AS VARCHAR)"
            f" || '% ' || CAST(40 + {part(11, 2)} % 20 AS VARCHAR) || '%)')")


def pct_sql(v: str, mx: str) -> str:
    a, m = f"CAST(round({v} * 100) AS BIGINT)", f"CAST(round({mx} * 100) AS BIGINT)"
    return f"CAST(({a} * 2000 + {m}) // ({m} * 2) AS DOUBLE) / CAST(10 AS DOUBLE)"


def bars_sql(items: str, order: str, limit: int, color: bool) -> str:
    col = f", {color_sql('label')} AS color" if color else ""
    return f"""
SELECT group_id, rn - 1 AS pos, label, CAST(v AS DOUBLE) AS amount, {pct_sql('v', 'mx')} AS pct{col}
FROM (SELECT *, max(v) OVER (PARTITION BY group_id) AS mx
      FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY {order}) AS rn
            FROM ({items}) WHERE v > 0)
      WHERE rn <= {limit})"""


register("bars_category", bars_sql(
    "SELECT group_id, category AS label, SUM(amount) AS v FROM expenses GROUP BY 1, 2", "v DESC, label", 20, True))

register("bars_monthly", bars_sql(
    "SELECT group_id, month AS label, SUM(amount) AS v FROM expenses GROUP BY 1, 2", "label DESC", 120, False))

register("bars_series", bars_sql(
    """SELECT e.group_id, e.month AS label, SUM(e.amount) AS v FROM expenses e
       JOIN sel s ON s.group_id = e.group_id AND s.category = e.category GROUP BY 1, 2""",
    "label DESC", 120, False), """
charted AS (SELECT group_id, category FROM expenses GROUP BY 1, 2 HAVING SUM(amount) > 0),
sel AS (SELECT group_id,
               CASE WHEN max(CASE WHEN category = 'HOUSEHOLD' THEN 1 ELSE 0 END) = 1 THEN 'HOUSEHOLD'
                    ELSE min(category) END AS category
        FROM charted GROUP BY 1)""")

register("person_month_groups", f"""
SELECT c.group_id, c.month, CAST(coalesce(r.rank, 10000) AS BIGINT) AS month_rank, c.person,
       CAST(c.v AS DOUBLE) AS amount, {pct_sql('c.v', 'c.mx')} AS pct, {color_sql('c.person')} AS color
FROM (SELECT m.group_id, m.month, p.member AS person, coalesce(s.v, 0) AS v,
             greatest(max(coalesce(s.v, 0)) OVER (PARTITION BY m.group_id), 1) AS mx
      FROM pm_months m JOIN pm_persons p ON p.group_id = m.group_id
      LEFT JOIN pm_sums s ON s.group_id = m.group_id AND s.month = m.month AND s.member = p.member) c
LEFT JOIN (SELECT group_id, month, dense_rank() OVER (PARTITION BY group_id ORDER BY month DESC) - 1 AS rank
           FROM (SELECT DISTINCT group_id, month FROM expenses WHERE trim(month) <> '')) r
  ON r.group_id = c.group_id AND r.month = c.month""", _person_month_ctes("net_rev"))

WIDE_NET = _wide_ctes("net_rev")
RAW_SELECT = "date, month, description, category, CAST(amount AS DOUBLE) AS amount, currency, expense_id, owes"
HAYSTACK = (f"lower(concat_ws(' ', date, month, description, category, {pyfloat_sql('amount')}, currency, "
            "CAST(expense_id AS VARCHAR), amounts))")

register("recent_expenses", f"""
SELECT group_id, pos, {RAW_SELECT}
FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY date DESC, expense_id) - 1 AS pos FROM wide)
WHERE pos < 30""", WIDE_NET)

register("text_search", f"""
SELECT group_id, {RAW_SELECT} FROM wide WHERE contains({HAYSTACK}, 'high auto')""", WIDE_NET)

SCOPED = WIDE_NET + f""",
has AS (SELECT group_id, max(CASE WHEN month = '1997-06' THEN 1 ELSE 0 END) AS h FROM wide GROUP BY 1),
scoped AS (SELECT * FROM wide WHERE contains({HAYSTACK}, 'urgent')
           AND (month = '1997-06' OR group_id IN (SELECT group_id FROM has WHERE h = 0)))"""

register("table_page", f"""
SELECT f.group_id, f.pos, {RAW_SELECT}, t.raw_total
FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY date DESC, expense_id) - 1 AS pos
      FROM scoped) f
JOIN (SELECT group_id, COUNT(*) AS raw_total FROM scoped GROUP BY 1) t ON t.group_id = f.group_id
WHERE f.pos < 500""", SCOPED)

register("format_money", """
SELECT group_id, expense_id, '₪' || format('{:,.2f}', CAST(amount AS DOUBLE)) AS amount_text, money AS owes_text
FROM wide""", WIDE_NET)

register("label_color", f"""
SELECT label, {color_sql('label')} AS color
FROM (SELECT category AS label FROM expenses UNION SELECT person AS label FROM shares)""")

register("table_payload", """
SELECT group_id, expense_id, j[:-2] || ',' || json || '}' AS row_json
FROM (SELECT group_id, expense_id, json, CAST(to_json(struct_pack(
        date := date, month := month, description := description, category := category,
        amount := round(CAST(amount AS DOUBLE), 2), currency := currency, expense_id := expense_id)) AS VARCHAR) AS j
      FROM wide)""", WIDE_NET)

register("payload_columns", """
SELECT group_id, 'date,month,description,category,amount,currency,expense_id,'
                 || string_agg(member || '_owes', ',' ORDER BY ord) AS columns
FROM member_names GROUP BY 1""")

register("exact_money", """
SELECT l_suppkey AS suppkey, CAST(SUM(CAST('0.00' || l_linenumber AS DECIMAL(32,8))) AS VARCHAR) AS tiny_sum,
       CAST(SUM(CAST(l_linenumber AS HUGEINT) * 100000000000000000) AS VARCHAR) AS huge_sum
FROM lineitem GROUP BY 1""")

register("coerce_numbers", """
SELECT l_orderkey, l_linenumber, format('{:,.2f}', l_extendedprice) AS raw_comma,
       CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE) AS share_value,
       CASE WHEN contains(format('{:,.2f}', l_extendedprice), ',') THEN CAST(0 AS DOUBLE)
            ELSE CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE) END AS cost_value,
       ' ' || CAST(l_quantity AS VARCHAR) || 'd' AS raw_junk, CAST(0 AS DOUBLE) AS junk_value,
       CAST(CAST(l_discount AS DECIMAL(18,2)) AS DOUBLE) AS spaced_value
FROM lineitem""")

register("members_from_json", "SELECT group_id, user_id, name, ord FROM members")

# ------------------------------------------------------------------ sinks and streams
# The export of a first run (empty store) is the expense table widened with owed shares.
QUERIES["sink_roundtrip"] = QUERIES["widen_owes"]

register("sink_shares", """
SELECT group_id, month, COUNT(*) AS n, CAST(SUM(owed_share) AS DOUBLE) AS owed, CAST(SUM(paid_share) AS DOUBLE) AS paid
FROM shares GROUP BY 1, 2""")

# Landed documents: ids divisible by 10 end deleted, other ids divisible by 4 edited.
register("latest_documents", """
SELECT h.group_id, h.id, h.updated_at || CASE WHEN h.id % 10 = 0 THEN '+2' WHEN h.id % 4 = 0 THEN '+1' ELSE '' END AS updated_at,
       CASE WHEN h.id % 10 = 0 THEN '2003-01-01' ELSE h.deleted_at END AS deleted_at,
       h.description || CASE WHEN h.id % 10 <> 0 AND h.id % 4 = 0 THEN ' (edited)' ELSE '' END AS description,
       CAST(h.amount AS VARCHAR) AS cost, coalesce(u.n, 0) AS n_users
FROM hdr h LEFT JOIN (SELECT l_orderkey, COUNT(*) AS n FROM lineitem GROUP BY 1) u ON u.l_orderkey = h.id""")

LANDED = """
landed AS (
  SELECT group_id, expense_id, date, updated_at || CASE WHEN expense_id % 4 = 0 THEN '+1' ELSE '' END AS updated_at, month,
         description || CASE WHEN expense_id % 4 = 0 THEN ' (edited)' ELSE '' END AS description, category, amount, currency
  FROM expenses WHERE expense_id % 10 <> 0)"""

register("landed_summary", """
SELECT group_id, COUNT(*) AS expense_count, CAST(SUM(amount) AS DOUBLE) AS total_expenses,
       array_to_string(list_sort(list_distinct(list(currency) FILTER (WHERE trim(currency) <> ''))), ',') AS currencies
FROM landed GROUP BY 1""", LANDED)
register("landed_person_month", PERSON_MONTH, _person_month_ctes("owed_share", "expense_id % 10 <> 0"))
register("stream_upsert", f"SELECT {EXPENSE_COLS} FROM landed", LANDED)
register("stream_shares", """
SELECT group_id, expense_id, user_id, person, month,
       CAST(owed_share AS DOUBLE) AS owed_share, CAST(paid_share AS DOUBLE) AS paid_share
FROM shares WHERE expense_id % 10 <> 0""")

# ------------------------------------------------------------------ composed views
register("dashboard_view", """
SELECT g.group_id,
       CASE WHEN cm.ok THEN '1997-06' ELSE 'all' END AS selected_category_month,
       'all' AS selected_person_month,
       sc.category AS selected_category,
       sm.scoped_count, sm.scoped_total,
       td.from_name AS top_debt_from, td.to_name AS top_debt_to, CAST(td.amount AS DOUBLE) AS top_debt_amount,
       cb.n AS n_category_bars, mb.n AS n_monthly_bars, smb.n AS n_category_month_bars, pmn.n AS n_person_months
FROM (SELECT CAST(n_nationkey AS BIGINT) AS group_id FROM nation) g
LEFT JOIN (SELECT group_id, bool_or(month = '1997-06') AS ok FROM expenses GROUP BY 1) cm ON cm.group_id = g.group_id
LEFT JOIN (SELECT group_id, min(category) AS category FROM charted GROUP BY 1) sc ON sc.group_id = g.group_id
LEFT JOIN (SELECT e.group_id, COUNT(*) AS scoped_count, CAST(SUM(e.amount) AS DOUBLE) AS scoped_total
           FROM expenses e JOIN (SELECT group_id, bool_or(month = '1997-06') AS ok FROM expenses GROUP BY 1) v
             ON v.group_id = e.group_id
           WHERE NOT v.ok OR e.month = '1997-06' GROUP BY 1) sm ON sm.group_id = g.group_id
LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY amount DESC, from_id, to_id) AS rn
                          FROM edges) WHERE rn = 1) td ON td.group_id = g.group_id
LEFT JOIN (SELECT e.group_id, least(COUNT(*), 20) AS n FROM (
             SELECT e.group_id, e.category FROM expenses e
             JOIN (SELECT group_id, bool_or(month = '1997-06') AS ok FROM expenses GROUP BY 1) v
               ON v.group_id = e.group_id
             WHERE NOT v.ok OR e.month = '1997-06' GROUP BY 1, 2 HAVING SUM(e.amount) > 0) e GROUP BY 1) cb
  ON cb.group_id = g.group_id
LEFT JOIN (SELECT group_id, least(COUNT(*), 120) AS n FROM (
             SELECT group_id, month FROM expenses GROUP BY 1, 2 HAVING SUM(amount) > 0) GROUP BY 1) mb
  ON mb.group_id = g.group_id
LEFT JOIN (SELECT group_id, least(COUNT(*), 120) AS n FROM (
             SELECT e.group_id, e.month FROM expenses e
             JOIN (SELECT group_id, min(category) AS category FROM charted GROUP BY 1) s
               ON s.group_id = e.group_id AND s.category = e.category
             GROUP BY 1, 2 HAVING SUM(e.amount) > 0) GROUP BY 1) smb ON smb.group_id = g.group_id
LEFT JOIN (SELECT group_id, COUNT(DISTINCT month) AS n FROM tracked GROUP BY 1) pmn ON pmn.group_id = g.group_id""",
         EDGES + """,
charted AS (SELECT group_id, category FROM expenses GROUP BY 1, 2 HAVING SUM(amount) > 0)""")

register("tables_view", """
SELECT g.group_id, CASE WHEN h.h = 1 THEN '1997-06' ELSE 'all' END AS selected_month, 'urgent' AS query,
       coalesce(t.n, 0) AS raw_total, least(coalesce(t.n, 0), 50) AS raw_shown, 50 AS table_limit
FROM (SELECT CAST(n_nationkey AS BIGINT) AS group_id FROM nation) g
LEFT JOIN has h ON h.group_id = g.group_id
LEFT JOIN (SELECT group_id, COUNT(*) AS n FROM scoped GROUP BY 1) t ON t.group_id = g.group_id""", SCOPED)

register("dashboard_category_bars", bars_sql("""
SELECT e.group_id, e.category AS label, SUM(e.amount) AS v FROM expenses e
JOIN (SELECT group_id, bool_or(month = '1997-06') AS ok FROM expenses GROUP BY 1) s ON s.group_id = e.group_id
WHERE NOT s.ok OR e.month = '1997-06' GROUP BY 1, 2""", "v DESC, label", 20, True))

PM_GRID = _person_month_ctes("net_rev") + """,
pm_order AS (SELECT p.group_id, p.member, n.ord FROM pm_persons p JOIN member_names n USING (group_id, member)),
pm_grid AS (SELECT m.group_id, m.month, p.member, p.ord, coalesce(s.v, 0) AS v,
                   sum(coalesce(s.v, 0)) OVER (PARTITION BY m.group_id, m.month) AS total
            FROM pm_months m JOIN pm_order p ON p.group_id = m.group_id
            LEFT JOIN pm_sums s ON s.group_id = m.group_id AND s.month = m.month AND s.member = p.member)"""

register("dashboard_person_groups", f"""
SELECT c.group_id, c.month, CAST(coalesce(r.rank, 10000) AS BIGINT) AS month_rank, c.member AS person,
       CAST(c.v AS DOUBLE) AS amount, {pct_sql('c.v', 'c.mx')} AS pct, {color_sql('c.member')} AS color
FROM (SELECT p.*, greatest(max(v) OVER (PARTITION BY p.group_id), 1) AS mx FROM pm_grid p
      JOIN (SELECT group_id, bool_or(month = '1997-06') AS ok FROM expenses GROUP BY 1) s ON s.group_id = p.group_id
      WHERE NOT s.ok OR p.month = '1997-06') c
LEFT JOIN (SELECT group_id, month, dense_rank() OVER (PARTITION BY group_id ORDER BY month DESC) - 1 AS rank
           FROM (SELECT DISTINCT group_id, month FROM expenses WHERE trim(month) <> '')) r
  ON r.group_id = c.group_id AND r.month = c.month""", PM_GRID)

MC_GRID = """
mc_grid AS (
  SELECT m.group_id, m.month, c.category, coalesce(s.v, 0) AS v, m.t AS total
  FROM (SELECT group_id, month, SUM(amount) AS t FROM expenses GROUP BY 1, 2) m
  JOIN (SELECT DISTINCT group_id, category FROM expenses) c ON c.group_id = m.group_id
  LEFT JOIN (SELECT group_id, month, category, SUM(amount) AS v FROM expenses GROUP BY 1, 2, 3) s
    ON s.group_id = m.group_id AND s.month = m.month AND s.category = c.category)"""

register("tables_monthly", """
SELECT g.group_id, g.month, row_number() OVER (PARTITION BY g.group_id, g.month ORDER BY category) - 1 AS pos,
       category AS label, CAST(v AS DOUBLE) AS amount, CAST(total AS DOUBLE) AS total
FROM mc_grid g JOIN (SELECT group_id, bool_or(month = '1997-06') AS ok FROM expenses GROUP BY 1) s ON s.group_id = g.group_id
WHERE NOT s.ok OR g.month = '1997-06'""", MC_GRID)

register("tables_person", f"""
SELECT group_id, month, row_number() OVER (PARTITION BY group_id, month ORDER BY ord) - 1 AS pos, member AS label,
       CAST(v AS DOUBLE) AS amount, CAST(total AS DOUBLE) AS total
FROM pm_grid JOIN (SELECT group_id, month, month || ' ' || string_agg({pyfloat_sql('v')}, ' ' ORDER BY ord) || ' '
                          || {pyfloat_sql('any_value(total)')} AS text FROM pm_grid GROUP BY 1, 2) USING (group_id, month)
WHERE contains(text, '97-')""", PM_GRID)


def _part(name: str, select: str) -> str:
    return f"SELECT group_id, '{name}' AS part, key, pos, label, amount FROM ({select})"


def _ranked(source: str, order: str, label: str, amount: str, key: str = "CAST(NULL AS VARCHAR)",
            within: str = "group_id") -> str:
    return (f"SELECT group_id, {key} AS key, row_number() OVER (PARTITION BY {within} ORDER BY {order}) - 1 AS pos, "
            f"{label} AS label, {amount} AS amount FROM ({source})")


_NO_AMOUNT = "CAST(NULL AS DOUBLE)"
_AMOUNT = "CAST(round(v, 2) AS DOUBLE)"
_MONTHS = "SELECT group_id, month, SUM(amount) AS v FROM expenses GROUP BY 1, 2"
_CATEGORIES = "SELECT group_id, category, SUM(amount) AS v FROM expenses GROUP BY 1, 2 HAVING SUM(amount) > 0"
_CELLS = "SELECT group_id, month, category, SUM(amount) AS v FROM expenses GROUP BY 1, 2, 3 HAVING SUM(amount) > 0"
_TOTALS = """SELECT n.group_id, n.member, n.ord, coalesce(s.v, 0) AS v FROM member_names n
  LEFT JOIN (SELECT group_id, member, SUM(net_rev) AS v FROM kept_tracked GROUP BY 1, 2) s
    ON s.group_id = n.group_id AND s.member = n.member"""
_BY_MONTH = """SELECT m.group_id, m.month, n.member, n.ord, coalesce(s.v, 0) AS v
  FROM (SELECT DISTINCT group_id, month FROM expenses) m JOIN member_names n ON n.group_id = m.group_id
  LEFT JOIN (SELECT group_id, month, member, SUM(net_rev) AS v FROM kept_tracked GROUP BY 1, 2, 3) s
    ON s.group_id = m.group_id AND s.month = m.month AND s.member = n.member"""


def _balance(end: str) -> str:
    return f"""SELECT n.group_id, n.member, n.ord, coalesce(s.v, 0) AS v FROM member_names n
  LEFT JOIN (SELECT group_id, {end} AS nm, SUM(amount) AS v FROM edges GROUP BY 1, 2) s
    ON s.group_id = n.group_id AND s.nm = n.member"""


def _month_table(grid: str, label: str, order: str) -> str:
    """Cells of a month table with their total, positioned by month."""
    return f"""SELECT group_id, month AS key, dense_rank() OVER (PARTITION BY group_id ORDER BY month {order}) - 1 AS pos,
  label, amount FROM (SELECT group_id, month, {label} AS label, {_AMOUNT} AS amount FROM {grid}
    UNION ALL SELECT DISTINCT group_id, month, 'Total', CAST(round(total, 2) AS DOUBLE) FROM {grid})"""


NEWEST = """
newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY date DESC, expense_id) - 1 AS pos FROM expenses) WHERE pos < 30)"""

register("snapshot_json", "\nUNION ALL\n".join([
    _part("group", f"""SELECT CAST(n_nationkey AS BIGINT) AS group_id, key, 0 AS pos, CASE key WHEN 'group_name' THEN n_name
      ELSE '1970-01-01T00:00:00+00:00' END AS label, {_NO_AMOUNT} AS amount FROM nation, (VALUES ('group_name'), ('generated_at')) AS t(key)"""),
    _part("range", f"""SELECT CAST(n_nationkey AS BIGINT) AS group_id, key, 0 AS pos, label, {_NO_AMOUNT} AS amount
      FROM nation, (VALUES ('start_month', '1995-01'), ('end_month', '2001-12')) AS t(key, label)"""),
    _part("summary", """SELECT g.group_id, CAST(NULL AS VARCHAR) AS key, 0 AS pos, 'expense_count' AS label, CAST(COUNT(expense_id) AS DOUBLE) AS amount
      FROM (SELECT CAST(n_nationkey AS BIGINT) AS group_id FROM nation) g LEFT JOIN expenses e ON e.group_id = g.group_id GROUP BY 1"""),
    _part("summary", """SELECT g.group_id, CAST(NULL AS VARCHAR) AS key, 0 AS pos, 'total_expenses' AS label,
      CAST(round(coalesce(SUM(amount), 0), 2) AS DOUBLE) AS amount
      FROM (SELECT CAST(n_nationkey AS BIGINT) AS group_id FROM nation) g LEFT JOIN expenses e ON e.group_id = g.group_id GROUP BY 1"""),
    _part("currencies", _ranked("SELECT DISTINCT group_id, currency FROM expenses WHERE trim(currency) <> ''",
                                "currency", "currency", _NO_AMOUNT)),
    _part("months", _ranked(f"SELECT * FROM ({_MONTHS}) WHERE trim(month) <> ''", "month DESC", "month", _NO_AMOUNT)),
    _part("owes", _ranked(_balance("from_name"), "ord", "member", _AMOUNT)),
    _part("to_receive", _ranked(_balance("to_name"), "ord", "member", _AMOUNT)),
    *[_part(f"debt_{end}", f"SELECT group_id, CAST({end}_id AS VARCHAR) AS key, pos, {end}_name AS label, "
            "CAST(amount AS DOUBLE) AS amount FROM edges") for end in ("from", "to")],
    _part("monthly_totals", _ranked(_MONTHS, "month DESC", "month", _AMOUNT)),
    _part("category_totals_all", _ranked(_CATEGORIES, "v DESC, category", "category", _AMOUNT)),
    _part("categories", _ranked(_CATEGORIES, "category", "category", _NO_AMOUNT)),
    _part("person_totals_all", _ranked(_TOTALS, "ord", "member", _AMOUNT)),
    _part("category_totals_by_month", _ranked(_CELLS, "v DESC, category", "category", _AMOUNT, "month", "group_id, month")),
    _part("category_month_series", _ranked(_CELLS, "month DESC", "month", _AMOUNT, "category", "group_id, category")),
    _part("person_totals_by_month", _ranked(_BY_MONTH, "ord", "member", _AMOUNT, "month", "group_id, month")),
    _part("monthly_by_category", _month_table("mc_grid", "category", "")),
    _part("per_person_month", _month_table("pm_grid", "member", "DESC")),
    _part("recent_expenses_columns", "SELECT group_id, CAST(NULL AS VARCHAR) AS key, pos, label, " + _NO_AMOUNT + """ AS amount FROM (
      SELECT group_id, 6 + row_number() OVER (PARTITION BY group_id ORDER BY ord) AS pos, member || '_owes' AS label FROM member_names
      UNION ALL
      SELECT DISTINCT group_id, p, c FROM member_names, (VALUES (0, 'date'), (1, 'month'), (2, 'description'), (3, 'category'),
        (4, 'amount'), (5, 'currency'), (6, 'expense_id')) AS t(p, c))"""),
    *[_part(f"{table}_columns", f"""SELECT group_id, CAST(NULL AS VARCHAR) AS key, row_number() OVER (PARTITION BY group_id ORDER BY o) - 1 AS pos,
        label, {_NO_AMOUNT} AS amount FROM (SELECT group_id, 'month' AS label, 0 AS o FROM {grid} GROUP BY 1
        UNION ALL SELECT group_id, label, row_number() OVER (PARTITION BY group_id ORDER BY o)
          FROM (SELECT group_id, {label} AS label, {order} AS o FROM {grid} GROUP BY group_id, {label})
        UNION ALL SELECT group_id, 'Total', 1000000 FROM {grid} GROUP BY 1)""")
      for table, grid, label, order in (("monthly_by_category", "mc_grid", "category", "category"), ("per_person_month", "pm_grid", "member", "min(ord)"))],
    _part("recent_expenses", f"""SELECT group_id, key, pos, CASE key WHEN 'date' THEN date WHEN 'month' THEN month WHEN 'description' THEN description
        WHEN 'category' THEN category WHEN 'currency' THEN currency WHEN 'expense_id' THEN CAST(expense_id AS VARCHAR) END AS label,
        CASE key WHEN 'amount' THEN CAST(amount AS DOUBLE) END AS amount
      FROM newest, (VALUES ('date'), ('month'), ('description'), ('category'), ('amount'), ('currency'), ('expense_id')) AS t(key)
      UNION ALL SELECT w.group_id, n.member || '_owes', pos, CAST(NULL AS VARCHAR), CAST(coalesce(round(SUM(t.net_rev), 2), 0) AS DOUBLE)
      FROM newest w JOIN member_names n ON n.group_id = w.group_id
      LEFT JOIN kept_tracked t ON t.group_id = w.group_id AND t.expense_id = w.expense_id AND t.member = n.member
      GROUP BY w.group_id, n.member, pos"""),
]), EDGES + "," + KEPT_TRACKED + "," + PM_GRID + "," + MC_GRID + "," + NEWEST)

# The same over the landed documents: edits and deletions of the second drop, no month range.
_DROPS = [("WHEN o.o_orderkey % 23 = 0 THEN", "WHEN o.o_orderkey % 23 = 0 OR o.o_orderkey % 10 = 0 THEN"),
          ("o.o_orderpriority || ' ' || c.c_mktsegment AS description",
           "o.o_orderpriority || ' ' || c.c_mktsegment || CASE WHEN o.o_orderkey % 4 = 0 THEN ' (edited)' ELSE '' END AS description"),
          ("('start_month', '1995-01'), ('end_month', '2001-12')", "('start_month', NULL), ('end_month', NULL)")]
QUERIES["stream_dashboard"] = QUERIES["snapshot_json"]
for _plain, _landed in _DROPS:
    assert _plain in QUERIES["stream_dashboard"]
    QUERIES["stream_dashboard"] = QUERIES["stream_dashboard"].replace(_plain, _landed)
