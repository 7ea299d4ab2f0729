"""Results as text: table, JSON lines or CSV.  For the rows that are shown."""

from __future__ import annotations

import csv
import io
import json

from pyspark.sql import DataFrame


def _plain(value: object) -> object:
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return [_plain(v) for v in value]
    return value if value is None or isinstance(value, bool | int | float | str) else str(value)


def render(df: DataFrame, form: str = "table", limit: int = 1000) -> str:
    """The rows as text.  A table shows `limit` rows and says if there are more;
    JSON and CSV are never cut: more than `limit` rows are refused, as they
    belong in files (see transfer)."""
    rows = [[_plain(v) for v in r] for r in df.limit(limit + 1).collect()]
    more = len(rows) > limit
    if more and form in ("json", "csv"):
        raise ValueError(f"over {limit} rows: export them, or give a larger limit")
    rows = rows[:limit]
    if form == "json":
        return json.dumps([dict(zip(df.columns, r, strict=True)) for r in rows], ensure_ascii=False)
    if form == "csv":
        out = io.StringIO()
        writer = csv.writer(out, lineterminator="\n")
        writer.writerow(df.columns)
        writer.writerows([["" if v is None else v for v in r] for r in rows])
        return out.getvalue()
    cells = [df.columns] + [["NULL" if v is None else str(v) for v in r] for r in rows]
    widths = [max(len(c[i]) for c in cells) for i in range(len(df.columns))]
    line = "+" + "+".join("-" * (w + 2) for w in widths) + "+"
    shown = ["|" + "|".join(f" {v:<{w}} " for v, w in zip(c, widths, strict=True)) + "|" for c in cells]
    return "\n".join([line, shown[0], line, *shown[1:], line, f"first {len(rows)} rows, there are more" if more else f"{len(rows)} row(s)"])
