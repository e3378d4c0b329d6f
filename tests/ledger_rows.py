"""Hand-made documents with one quirk each (see FIXTURES.md §3), and a helper to compare rows."""

from __future__ import annotations

GID = 7


def _user(uid, owed, paid, first_name=None):
    return {"user_id": str(uid), "user": {"id": str(uid), "first_name": first_name}, "owed_share": owed,
            "paid_share": paid}


def _doc(i, date, cost, desc, cat, cur, deleted, users):
    return {"group_id": GID, "id": i, "date": date, "updated_at": f"{date or '2024-01-01'}T10:00:00Z",
            "deleted_at": deleted, "cost": cost, "currency_code": cur, "description": desc,
            "category": {"name": cat} if cat is not None else None, "users": users}


DOCS = [
    _doc(1, "2024-01-05", "100.00", "Market", "Groceries", "ILS", None,
         [_user(101, "60", "100"), _user(102, "40", "0")]),
    _doc(2, "2024-01-20", "1,234.5", "Fuel", None, "ILS", None,
         [_user(101, "1,000.5", "0"), _user(102, "0", "1,000.5")]),
    _doc(3, "2024-01-25", "50", "Settle", "Payment", "ILS", None,
         [_user(101, "50", "0"), _user(102, "0", "50")]),
    _doc(4, "2024-03-02", "80", "Paris trip", "Trips", "EUR", None,
         [_user(101, "80", "0"), _user(103, "0", "80")]),
    _doc(5, "2024-03-09", "10", "Gone", "Trips", "ILS", "2024-03-10", [_user(101, "10", "10")]),
    _doc(6, None, "5", "Undated", "Groceries", "ILS", None, [_user(101, "5", "5")]),
]
MEMBERS_JSON = '{"101": "Alice", "102": "Bob"}'
DEBTS = [(GID, "101", "102", "30"), (GID, "102", "103", "-5"), (GID, '{"id": 103}', "101", "12")]


def rows(df, *cols, sort=True):
    out = [tuple(r[c] for c in cols) for r in df.select(*cols).collect()]
    return sorted(out, key=lambda t: tuple("" if v is None else str(v) for v in t)) if sort else out
