"""Line dedup by site-relative frequency.

A page's host groups it with its site. For every line, the share of the site's pages that hold it
is compared with a boilerplate ratio; lines above it, on enough pages, are dropped from every page
of that site. The line order and the other lines stay.

Only line hashes are shuffled for the counts (a page counts once for a line, and partial counts
come before the shuffle, so a line on every page of a hot site is one row per task), and only
boilerplate lines come back to the pages.

Nulls: a null text has no lines; a null host is a site of its own. Pages of one id and host share
the decision, and rows that repeat a page count each. Blank lines are never boilerplate. Empty tables
give empty results. Texts are taken whole, however long. A page's own columns travel in ``row``,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A line is boilerplate on more than this share of a site's pages, and on this many pages.
RATIO, LEAST = 0.1, 3


def host(url: Column) -> Column:
    """The lower-cased host of a URL without port; null where there is none."""
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1))
    return F.when(found != "", found)


def html_lines(html: Column) -> Column:
    """Runs of text between tags or line ends, trimmed, without empty ones."""
    flat = F.regexp_replace(F.coalesce(html, F.lit("")), r"<[^>]*>", "\n")
    return F.filter(F.transform(F.split(flat, r"[\r\n]+"), lambda x: F.trim(x)), lambda x: x != "")


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def boilerplate(pages: DataFrame, ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """_host, _line (hash) of boilerplate, from columns _host and _hashes (an array)."""
    held = pages.select("_host", F.explode(F.array_distinct("_hashes")).alias("_line"))
    counts = held.groupBy("_host", "_line").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    totals = pages.groupBy(F.col("_host").alias("_site")).agg(F.count("*").alias("total"))
    both = counts.join(totals, F.col("_host").eqNullSafe(F.col("_site")))
    return both.filter(F.col("n") > F.col("total") * ratio).select("_host", "_line")


def drop_lines(pages: DataFrame, page_id: Column, site: Column, lines: Column, ratio: float = RATIO, least: int = LEAST, same: Column | None = None, carry: list[str] | None = None) -> DataFrame:
    """row (the page's own columns, or those of ``carry``), _host, _kept (lines that stay) and _lines (their number before).

    Pages of one site that agree in ``same`` are counted as one.
    """
    hashes = lambda a: F.transform(a, lambda x: F.when(F.trim(x) != "", F.xxhash64(x)))
    row = F.struct(*[F.col(f"`{c}`") for c in carry or pages.columns])
    full = pages.select(row.alias("row"), page_id.alias("_page"), site.alias("_host"), lines.alias("_all"), (F.lit(0) if same is None else same).alias("_same"))
    hashed = full.select("_page", "_host", "_same", F.filter(hashes(F.col("_all")), lambda x: x.isNotNull()).alias("_hashes"))
    counted = hashed if same is None else hashed.groupBy("_host", "_same").agg(F.first("_hashes").alias("_hashes"))
    common = boilerplate(counted, ratio, least).select(F.col("_host").alias("_site"), F.col("_line").alias("_common"))
    found = hashed.select("_page", "_host", F.explode(F.array_distinct("_hashes")).alias("_line"))
    marks = found.join(common, F.col("_host").eqNullSafe(F.col("_site")) & (F.col("_line") == F.col("_common")))
    drops = marks.groupBy(F.col("_page").alias("_of"), F.col("_host").alias("_at")).agg(F.collect_set("_line").alias("_drop"))
    marked = full.join(drops, F.col("_page").eqNullSafe(F.col("_of")) & F.col("_host").eqNullSafe(F.col("_at")), "left")
    stays = F.filter("_all", lambda x: (F.trim(x) == "") | ~F.array_contains(F.col("_drop"), F.xxhash64(x)))
    kept = F.when(F.col("_drop").isNull(), F.col("_all")).otherwise(stays)
    return marked.select("row", "_host", kept.alias("_kept"), F.size("_all").alias("_lines"))


def clean_pages(pages: DataFrame, ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """page_id, host, text (kept lines joined by line ends), n_lines, n_removed."""
    done = drop_lines(pages, F.col("page_id"), host(F.col("url")), html_lines(F.col("html")), ratio, least, carry=["page_id"])
    return done.select(
        "row.page_id", F.col("_host").alias("host"), F.array_join("_kept", "\n").alias("text"),
        F.col("_lines").cast("long").alias("n_lines"), (F.col("_lines") - F.size("_kept")).cast("long").alias("n_removed"),
    )


def clean_documents(documents: DataFrame, ratio: float = RATIO, least: int = LEAST, once: bool = False) -> DataFrame:
    """Documents with boilerplate lines of their source removed; a null text stays null.

    With ``once`` exact copies of a text within a source count as one document, so that a group of
    copies does not make boilerplate of all its lines.
    """
    same = F.xxhash64("text") if once else None
    done = drop_lines(documents, F.col("doc_id"), F.col("source"), text_lines(F.col("text")), ratio, least, same)
    text = F.when(F.col("row.text").isNotNull(), F.array_join("_kept", "\n")).alias("text")
    return done.select(*[text if c == "text" else F.col(f"row.`{c}`") for c in documents.columns])
