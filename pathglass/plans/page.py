"""Pages: a bounded number of rows, fitted to a budget of bytes."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

#: Bytes of a page as JSON.
BUDGET = 32 * 1024
#: Text fields up to this long are never shortened.
SHORT_TEXT = 256


def take(df: DataFrame, order: list, offset: int, limit: int) -> tuple[list[dict], str | None]:
    """The rows of a page and the next cursor; one row more is read to know if there is one."""
    rows = [r.asDict(recursive=True) for r in df.orderBy(*order).offset(offset).limit(limit + 1).collect()]
    more = len(rows) > limit
    return rows[:limit], str(offset + limit) if more else None


def page_of(rows: list, offset: int, limit: int) -> tuple[list, str | None]:
    """The same for a list."""
    part = rows[offset : offset + limit]
    return part, str(offset + limit) if offset + limit < len(rows) else None


def _size(value) -> int:
    return len(json.dumps(value, separators=(",", ":"), default=str).encode())


def _shorten(row: dict) -> bool:
    """Halve the row's largest array or long text; False if it has none left."""
    best, size = None, 0
    for key, value in row.items():
        if key != "truncated_fields" and ((isinstance(value, list) and len(value) > 1) or (isinstance(value, str) and len(value) > SHORT_TEXT)) and (n := _size(value)) > size:
            best, size = key, n
    if best is None:
        return False
    row[best] = row[best][: len(row[best]) // 2]
    if best not in row.setdefault("truncated_fields", []):
        row["truncated_fields"].append(best)
    return True


def fit(envelope: dict, budget: int = BUDGET, offset: int = 0) -> dict:
    """``envelope`` with ``data`` cut to the budget.

    Rows at the end go first, back to a single one, and the cursor moves back to them.
    Then fields of that row are halved, largest first, and named. If that does
    not help, a note of an omitted row takes its place.
    """
    data = envelope.get("data")
    if not isinstance(data, list):
        return envelope
    data = [dict(r) for r in data]
    out = envelope | {"data": data}
    while _size(out) > budget and len(data) > 1:
        data.pop()
        out |= {"next_cursor": str(offset + len(data)), "truncated": True}
    while _size(out) > budget and data and _shorten(data[0]):
        out["truncated"] = True
    if _size(out) > budget and data:
        out |= {"data": [{"omitted": "the row exceeds the page's budget"}], "truncated": True}
    return out
