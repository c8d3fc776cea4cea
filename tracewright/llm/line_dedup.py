"""Boilerplate lines by their frequency within a site.

A line is boilerplate on a host when the pages of the host that hold it, divided by
all pages of the host, exceed ``max_ratio``. Each page counts once per line, and every row is a
page. Frequencies are partial sums over (host, line digest); the pages' texts are never
shuffled while the boilerplate set is within the broadcast bound, only 16 bytes for each line.
Beyond the bound the lines found in each page come from a shuffled join whose hot keys
adaptive execution splits.

Two parameters, off by default, change what counts: ``min_pages`` is the least number of pages
that hold a line, so that a site of a few pages does not lose its content, and with ``one_per_text``
pages with equal texts count as one, so that copies do not make boilerplate of their own content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import BROADCAST_ROWS, WORD, apart, back, cut

ADDED = ("n_lines", "n_dropped")


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _digests(text: Column) -> Column:
    """Digests (hex) of the distinct lines that have a word."""
    return F.array_distinct(F.transform(F.filter(_lines(text), lambda x: x.rlike(WORD)), F.md5))


def _host(host_col: str) -> Column:
    return F.coalesce(F.col(host_col).cast("string"), F.lit(""))


def site_boilerplate(df: DataFrame, host_col: str, text_col: str, max_ratio: float, min_pages: int = 1, one_per_text: bool = False) -> DataFrame:
    """(host, line, pages, ratio) of boilerplate; ``line`` is the md5 of the line's text."""
    digests = F.transform(_digests(F.col(text_col)), F.unhex)
    if one_per_text:
        pages = df.select(_host(host_col).alias("host"), F.unhex(F.md5(F.col(text_col))).alias("page"), digests.alias("lines")).groupBy("host", "page").agg(F.any_value("lines").alias("lines"))
    else:
        pages = df.select(_host(host_col).alias("host"), digests.alias("lines"))
    totals = pages.groupBy("host").agg(F.count("*").alias("total"))
    lines = pages.select("host", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    ratio = lines.join(totals, "host").withColumn("ratio", F.col("pages") / F.col("total")).where(F.col("ratio") > max_ratio)
    return ratio.select("host", F.lower(F.hex("line")).alias("line"), "pages", "ratio")


def drop_site_boilerplate(
    df: DataFrame,
    host_col: str = "source",
    text_col: str = "text",
    max_ratio: float = 0.05,
    min_pages: int = 1,
    one_per_text: bool = False,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """All rows and columns of ``df``, with ``text_col`` less its boilerplate lines.

    Adds ``n_lines`` and ``n_dropped`` (long; input columns of these names are
    replaced, all others come back as they are). Lines are what lies between line feeds; a line without a word is
    never boilerplate and stays. Texts are taken whole. Null and empty texts stay as they are, with 0
    lines dropped, and count among the pages of their host; a text all of whose lines go becomes empty. Rows with a null
    host form the site "". Repeated rows are pages of their own and all lose the same lines. An
    empty table gives no rows.

    A host's boilerplate has at most 1 / ``max_ratio`` times as many lines as its pages have
    on average, so the list that a page is held against stays small beside the page.
    """
    found = cut(site_boilerplate(df, host_col, text_col, max_ratio, min_pages, one_per_text).select("host", "line"))
    rows = apart(df, _on=_host(host_col), _body=F.col(text_col))
    if found.count() <= broadcast_rows:
        sites = found.groupBy(F.col("host").alias("_host")).agg(F.collect_list("line").alias("_site"))
        rows = rows.join(F.broadcast(sites), F.col("_on") == F.col("_host"), "left").withColumn("_gone", F.array_intersect(_digests(F.col("_body")), "_site"))
    else:
        rows = rows.withColumn("_text", F.md5("_body"))
        lines = rows.select("_on", "_text", F.explode(_digests(F.col("_body"))).alias("_line"))
        # equal texts of a host lose equal lines, so one row stands for them all
        gone = lines.join(found, (F.col("_on") == F.col("host")) & (F.col("_line") == F.col("line"))).groupBy(F.col("_on").alias("_host"), F.col("_text").alias("_key")).agg(F.collect_set("line").alias("_gone"))
        rows = rows.join(gone, (F.col("_on") == F.col("_host")) & (F.col("_text") == F.col("_key")), "left")
    lines = _lines(F.col("_body"))
    stay = F.filter(lines, lambda x: ~F.array_contains("_gone", F.md5(x)))
    at = [c.lower() for c in df.columns].index(text_col.lower())
    rows = rows.withColumn("_stay", F.when(F.size("_gone") > 0, stay)).withColumn(f"in_{at}", F.coalesce(F.array_join("_stay", "\n"), "_body"))
    return rows.select(
        *back(df.columns, ADDED),
        F.when(F.col("_body").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.when(F.col("_stay").isNull(), 0).otherwise(F.size(lines) - F.size("_stay")).cast("long").alias("n_dropped"),
    )
