"""Lines that recur across the pages of a site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize

#: A line that over this share of a site's pages holds is boilerplate there, if at least so many pages hold it.
MAX_RATIO, MIN_PAGES = 0.3, 3
#: Boilerplate lines of all hosts (a host name and 8 bytes each, under 50 MB) up to which they are broadcast.
BROADCAST_LINES = 500_000


def host_of(url: Column) -> Column:
    """Host of a URL in lower case; null where it has none."""
    return F.nullif(F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def html_lines(html: Column) -> Column:
    """Lines of a page: what stands between tags and line feeds, blanks collapsed, empty ones left out."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), "<[^>]*>", "\n")
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, "[\\x20\\x09-\\x0D]+", " ")))
    return F.filter(lines, lambda x: x != "")


def line_dedup(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    lines: Column | None = None,
    max_ratio: float = MAX_RATIO,
    min_pages: int = MIN_PAGES,
    broadcast_lines: int = BROADCAST_LINES,
) -> DataFrame:
    """(page_id, host, n_lines, n_removed, kept_text): lines go that too many pages of the host hold.

    A line's pages are counted once a page, over (host, line hash), and divided
    by the host's pages; a ratio above ``max_ratio`` on at least ``min_pages``
    pages is boilerplate (on a host of one or two pages every line is on over
    0.3 of them). A host can have at most (mean lines a page / max_ratio) such
    lines, whatever its size. All hosts' boilerplate is counted: up to
    ``BROADCAST_LINES`` lines it is broadcast, an array a host, and pages never
    move; beyond that the (page, line hash) pairs meet it on (host, line hash),
    and what each page loses joins the pages by row, so that no host's texts
    meet in one task.

    Null and empty pages have no lines. A null URL or one without a host is a
    host of its own. Repeated rows count as pages of their own. A ratio equal
    to ``max_ratio`` stays. An empty table gives an empty table. Kept lines are
    joined by line feeds.
    """
    lines = html_lines(F.col("html")) if lines is None else lines
    table = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), lines.alias("lines"))
    table = table.withColumn("hashes", F.transform("lines", lambda x: F.xxhash64(x)))
    hashed = table.select("host", F.array_distinct("hashes").alias("hashes"))
    totals = hashed.groupBy("host").agg(F.count(F.lit(1)).alias("pages")).select(F.col("host").alias("th"), "pages")
    counts = hashed.select("host", F.explode("hashes").alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.where(F.col("n") >= min_pages)
    often = counts.join(totals, F.col("host").eqNullSafe(F.col("th"))).where(F.col("n") > max_ratio * F.col("pages"))
    often = materialize(often.select(F.col("host").alias("bh"), "line"), "often")
    if often.count() <= broadcast_lines:
        drops = often.groupBy("bh").agg(F.collect_list("line").alias("all"))
        joined = table.join(F.broadcast(drops), F.col("host").eqNullSafe(F.col("bh")), "left")
        joined = joined.withColumn("drop", F.array_intersect("hashes", F.coalesce("all", F.array().cast("array<bigint>"))))
    else:
        table = materialize(table.withColumn("row", F.monotonically_increasing_id()), "page-lines")
        pairs = table.select("row", "host", F.explode(F.array_distinct("hashes")).alias("h"))
        hits = pairs.join(often, (F.col("h") == F.col("line")) & F.col("host").eqNullSafe(F.col("bh")), "left_semi")
        hits = hits.groupBy("row").agg(F.collect_list("h").alias("some"))
        joined = table.join(hits, "row", "left").withColumn("drop", F.coalesce("some", F.array().cast("array<bigint>")))
    kept = F.filter(F.arrays_zip(F.col("lines").alias("x"), F.col("hashes").alias("h")), lambda x: ~F.array_contains(F.col("drop"), x["h"]))
    joined = joined.select("page_id", "host", F.size("lines").cast("long").alias("n_lines"), F.transform(kept, lambda x: x["x"]).alias("kept"))
    return joined.select(
        "page_id", "host", "n_lines",
        (F.col("n_lines") - F.size("kept")).alias("n_removed"),
        F.array_join("kept", "\n").alias("kept_text"),
    )
