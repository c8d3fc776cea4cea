"""Writers of aggregated results."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame

#: Rows that a page shows; a report is an aggregate, and the rest is in the table.
PAGE_ROWS = 1000


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def html_page(df: DataFrame, title: str, rows: int = PAGE_ROWS) -> str:
    """A page with the first ``rows`` rows, which says how many it leaves out."""
    shown, total = df.limit(rows).collect(), df.count()
    cell = lambda tag, x: f"<{tag}>{html.escape('' if x is None else str(x))}</{tag}>"
    head = "".join(cell("th", c) for c in df.columns)
    body = "\n".join("<tr>" + "".join(cell("td", x) for x in r) + "</tr>" for r in shown)
    more = f"<p>{total - len(shown)} more rows</p>" if total > len(shown) else ""
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1><table><tr>{head}</tr>\n{body}</table>{more}</body></html>"
