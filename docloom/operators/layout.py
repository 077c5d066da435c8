"""Lines of pages to paragraphs: rows of boxes, running headers, reading order, breaks, and pages of places in a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import running_key
from .ordered import scan

# Shares of page height, column width or line height at which lines are told apart.
HEADER, FOOTER = 0.12, 0.10
ROW_OVERLAP, JOIN_GAP = 0.5, 1.0
GAP, SHORT, SHORT_SENTENCE, FULL, INDENT = 1.6, 0.3, 0.08, 0.1, 0.8
RUNNING_PAGES, RUNNING_SHARE = 3, 0.25
# What ends a sentence, breaks a word, numbers a page and begins an item.
SENTENCE_END = "[.!?。:;][\"'”’」』)\\]]*$"
HYPHEN = "[A-Za-z]-$"
PAGE_NUMBER = "^[-–—\\s]*\\d+\\s*(?:/\\s*\\d+)?[-–—\\s]*$"
ITEM = (
    "^(?:제\\s*\\d+\\s*[편장절관조]|부\\s*칙|[①-⑳]|[ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩ][.．]|\\d{1,2}[.．)）](?=\\s|[가-힣A-Za-z])"
    "|[가나다라마바사아자차카타파하][.．)）](?=\\s|[가-힣A-Za-z])|[(（]\\d{1,2}[)）]|[•·∙◦○●□■▪▫◆◇▶►※*\\-–—]\\s)"
)


def in_margin(y0: Column, y1: Column, height: Column) -> Column:
    return (y1 <= height * HEADER) | (y0 >= height * (1 - FOOTER))


def running_keys(lines: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """(doc, running): lines but for digits and blanks that stand on enough of a document's pages.

    Enough: three, and a quarter of the pages rounded up. ``lines`` holds the
    margins' lines, or all of them.
    """
    need = lines.groupBy(doc).agg(F.greatest(F.lit(RUNNING_PAGES), F.ceil(F.count_distinct(page) * RUNNING_SHARE)).alias("_need"))
    keys = lines.select(doc, page, running_key(F.col(text)).alias("running")).where(F.length("running") >= 2).distinct()
    found = keys.groupBy(doc, "running").agg(F.count(F.lit(1)).alias("pages"))
    return found.join(need, doc).where("pages >= _need").select(doc, "running", "pages")


def body_lines(lines: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """``lines`` (y0, y1, height) without page numbers and running lines in the margins."""
    margin = in_margin(F.col("y0"), F.col("y1"), F.col("height"))
    keys = running_keys(lines.where(margin), doc, page, text).select(doc, "running").withColumn("_r", F.lit(True))
    rows = lines.withColumns({"_m": margin, "running": running_key(F.col(text))}).join(keys, [doc, "running"], "left")
    drop = F.col("_m") & (F.col(text).rlike(PAGE_NUMBER) | F.coalesce("_r", F.lit(False)))
    return rows.where(~F.coalesce(drop, F.lit(False))).drop("_m", "_r", "running")


def _row_of(state: tuple, y0: float, y1: float) -> tuple:
    """The row a box joins: of the last three the latest that it overlaps by half the lower height, else a new one."""
    count, last = state
    for i in range(len(last) - 1, -1, -1):
        row, top, bottom = last[i]
        if min(bottom, y1) - max(top, y0) > ROW_OVERLAP * min(bottom - top, max(1.0, y1 - y0)):
            return (count, [*last[:i], (row, min(top, y0), max(bottom, y1)), *last[i + 1 :]]), row
    return (count + 1, [*last, (count, y0, y1)][-3:]), count


def box_rows(boxes: DataFrame, page: list[str], parts: int | None = None) -> DataFrame:
    """``boxes`` (page, x0, y0, x1, y1, text) with ``row``: boxes of a page that overlap in height share one. ``parts`` is the number of partitions, if not the session's."""
    rows = boxes.select(*page, *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")], "text")
    return scan(rows, page, [(F.col("y0") + F.col("y1")) / 2, "x0", "text"], "row", "int", lambda: (0, []), _row_of, ["y0", "y1"], parts)


def merge_rows(boxes: DataFrame, page: list[str]) -> DataFrame:
    """(page, row, x0, y0, x1, y1, text): boxes of a row joined while the gap is within the page's median line height."""
    h = Window.partitionBy(*page)
    w = Window.partitionBy(*page, "row").orderBy("x0", "x1", "text")
    rows = boxes.withColumn("_h", F.median(F.greatest(F.col("y1") - F.col("y0"), F.lit(1.0))).over(h))
    reach = F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_new", F.coalesce(F.col("x0") - reach > F.col("_h") * JOIN_GAP, F.lit(True)).cast("int"))
    rows = rows.withColumn("_part", F.sum("_new").over(w))
    words = F.transform(F.sort_array(F.collect_list(F.struct("x0", "x1", "text"))), lambda r: r["text"])
    out = rows.groupBy(*page, "row", "_part").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.array_join(words, " ").alias("text"))
    return out.drop("_part")


def reading_order(lines: DataFrame, page: list[str], gutter: str) -> DataFrame:
    """``lines`` with ``band``, ``column`` and ``place``: lines across a gutter part a page into bands, a band reads column by column.

    ``gutter`` is the x of the gap between two columns, or an array of them as
    ``columns.page_gutters`` gives it; null: one column.
    """
    from .columns import column_of

    if dict(lines.dtypes)[gutter].startswith("array"):
        column = column_of(F.col("x0"), F.col("x1"), F.col(gutter))
    else:
        across = F.coalesce((F.col("x0") < F.col(gutter)) & (F.col("x1") > F.col(gutter)), F.lit(False))
        column = F.when(across, -1).when(F.coalesce(F.col("x0") >= F.col(gutter), F.lit(False)), 1).otherwise(0)
    rows = lines.withColumn("column", column)
    across = (F.col("column") == -1).cast("int")
    down = Window.partitionBy(*page).orderBy("y0", "x0", "x1", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # a line across is a band of its own: odd numbers for those, even ones for what stands between
    rows = rows.withColumn("band", 2 * F.sum(across).over(down) - across)
    order = Window.partitionBy(*page).orderBy("band", "column", "y0", "x0", "x1", "text")
    return rows.withColumn("place", F.row_number().over(order))


def paragraphs(lines: DataFrame, page: list[str]) -> DataFrame:
    """(page, paragraph, text) of ``lines`` in reading order (band, column, place, x0, y0, x1, y1, text).

    A line starts a paragraph if it begins an item, if the one before it ends
    short of its column, after a wide gap or with an indent. Between bands and
    columns a paragraph goes on only after a full line that ends no sentence.
    """
    whole, cols = Window.partitionBy(*page), Window.partitionBy(*page, "column")
    run = Window.partitionBy(*page).orderBy("place")
    left = F.when(F.col("column") == -1, F.min("x0").over(whole)).otherwise(F.min("x0").over(cols))
    right = F.when(F.col("column") == -1, F.max("x1").over(whole)).otherwise(F.max("x1").over(cols))
    rows = lines.withColumns({"_left": left, "_right": right, "_h": F.median(F.greatest(F.col("y1") - F.col("y0"), F.lit(1.0))).over(whole)})
    was = {f"_p{c}": F.lag(c).over(run) for c in ("x1", "y1", "text", "band", "column", "_left", "_right")}
    rows = rows.withColumns(was)
    rows = rows.withColumn("_same", (F.col("_pband") == F.col("band")) & (F.col("_pcolumn") == F.col("column")))
    rows = rows.withColumn("_gap", F.when(F.col("_same"), F.col("y0") - F.col("_py1")))
    rows = rows.withColumn("_usual", F.median(F.when(F.col("_gap") > 0, F.col("_gap"))).over(Window.partitionBy(*page, "band", "column")))
    width = F.greatest(F.lit(1.0), F.col("_p_right") - F.col("_p_left"))
    short = lambda share: F.col("_px1") < F.col("_p_right") - width * share
    ended = F.col("_ptext").rlike(SENTENCE_END)
    starts = (
        F.when(F.col("_ptext").isNull() | F.col("text").rlike(ITEM) | short(SHORT) | (ended & short(SHORT_SENTENCE)), True)
        .when(~F.col("_same"), ended | short(FULL))
        .when(F.coalesce(F.col("_gap") > F.col("_usual") * GAP + 1, F.lit(False)), True)
        .otherwise(F.col("x0") - F.col("_left") > F.col("_h") * INDENT)
    )
    rows = rows.withColumn("paragraph", F.sum(starts.cast("int")).over(run))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("place", "text"))), lambda r: r["text"])
    return rows.groupBy(*page, "paragraph").agg(join_lines(parts).alias("text"))


def join_lines(parts: Column) -> Column:
    """Lines as one text; a hyphen goes if the next line begins in lower case."""
    def step(acc: Column, x: Column) -> Column:
        cut = acc.rlike(HYPHEN) & x.rlike("^\\p{Ll}")
        return F.when(acc == "", x).when(cut, F.concat(F.regexp_replace(acc, "-$", ""), x)).otherwise(F.concat_ws(" ", acc, x))

    return F.aggregate(parts, F.lit(""), step)


def split_pages(texts: DataFrame, key: str, text: str, marker: str = "\\[\\[PAGE (\\d+)\\]\\]") -> DataFrame:
    """(key, i, page, text): parts of a text between page markers, each with the number of the marker before it."""
    numbers = F.concat(F.array(F.lit(None).cast("string")), F.regexp_extract_all(F.col(text), F.lit(marker), F.lit(1)))
    parts = F.arrays_zip(numbers.alias("page"), F.split(text, marker.replace("(", "(?:")).alias("text"))
    rows = texts.select(key, F.posexplode(parts).alias("i", "p"))
    return rows.select(key, "i", F.col("p.page").cast("int").alias("page"), F.trim("p.text").alias("text")).where("text <> ''")


def pages_of(places: DataFrame, starts: DataFrame, key: str, at: str, out: str = "page") -> DataFrame:
    """``places`` with the page whose start is the last at or before ``at``; places unknown take the one before in order.

    ``starts`` has (key, page, start). Both sides go through one sort, with no
    range join.
    """
    cols = places.columns
    pages = starts.select(key, F.col("start").alias(at), F.col("page").alias("_page")).withColumn("_side", F.lit(0))
    both = places.withColumns({"_side": F.lit(1), "_page": F.lit(None).cast(dict(starts.dtypes)["page"])}).unionByName(pages, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(at, "_side", "_page").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn(out, F.last("_page", ignorenulls=True).over(w)).where("_side = 1")
    return found.withColumn(out, F.when(F.col(at).isNotNull(), F.col(out))).select(*cols, out)


def geometry(lines: DataFrame, doc: str) -> DataFrame:
    """(doc, x0, x1, gap): commonest rounded left edge (the smaller on ties), right edge, upper median of the gaps over 0."""
    modes = lines.groupBy(doc, F.round("x0").alias("x")).agg(F.count(F.lit(1)).alias("n"))
    left = modes.groupBy(doc).agg(F.max_by("x", F.struct("n", -F.col("x"))).alias("x0"))
    w = Window.partitionBy(doc, "page").orderBy("y0", "x0")
    gaps = lines.withColumn("_g", F.col("y0") - F.lag("y1").over(w))
    sorted_ = F.sort_array(F.collect_list(F.when(F.col("_g") > 0, F.col("_g"))))
    rest = gaps.groupBy(doc).agg(F.max("x1").alias("x1"), F.get(sorted_, F.floor(F.size(sorted_) / 2).cast("int")).alias("gap"))
    return left.join(rest, doc)
