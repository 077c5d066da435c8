"""Columns of printed pages: the gaps between them, from what the lines cover of a page's width, and the layout that most pages share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import cut_lineage, parts_for, scan
from .tables import _beside

# Shares of the page's width or lines, and distances in points.
NARROW, CENTRED, SEARCH, NOISE, NOISE_LEAST, WIDEST = 0.6, 0.05, 0.15, 0.1, 2, 0.5
LEAST_GAP, LEAST_LINES, LEAST_SHARE, LEAST_FILL, SAME_LAYOUT, TOLERANCE = 6, 3, 0.15, 0.5, 8.0, 1.0


#: Rows up to which a table of pages or documents goes to every task.
SMALL = 50_000


def _small(rows: DataFrame) -> DataFrame:
    """``rows``, for every task if they are few, so that lines stay where they are."""
    return F.broadcast(rows) if rows.count() <= SMALL else rows


#: What lines are dealt and sorted by: a page, behind its hash, as numbers sort faster.
KEY = ["_hash", "_page"]


def _key(page: list[str]) -> list[Column]:
    """``KEY`` of a page: a struct, as those are equal where their nulls are."""
    return [F.xxhash64(*page).alias("_hash"), F.struct(*page).alias("_page")]


def _paged(lines: DataFrame, page: list[str]) -> DataFrame:
    """(_hash, _page, x0, x1) of the lines with a place."""
    rows = lines.select(*_key(page), *[F.col(c).cast("double").alias(c) for c in ("x0", "x1")])
    return rows.where("x0 IS NOT NULL AND x1 IS NOT NULL")


def _judged(rows: DataFrame, parts: int) -> DataFrame:
    """``rows`` (``KEY``, x0, x1) with ``left``, ``right``, ``narrow`` and ``_edge``.

    A page's lines meet once, in one of ``parts`` partitions, sorted by their left edge; all that is asked of a
    page is a window over that, and what follows by page finds them dealt.
    """
    rows = rows.withColumn("_edge", F.bround(F.col("x0").cast("double"))).repartition(parts, *KEY).sortWithinPartitions(*KEY, "_edge")
    x0, x1 = (F.when(F.col("x0").isNotNull() & F.col("x1").isNotNull(), F.col(c).cast("double")) for c in ("x0", "x1"))
    whole = Window.partitionBy(*KEY)
    rows = rows.withColumns({"left": F.min(x0).over(whole), "right": F.max(x1).over(whole)})
    width, middle = F.col("right") - F.col("left"), (F.col("left") + F.col("right")) / 2
    rows = rows.withColumn("narrow", F.coalesce(x1 - x0 < width * NARROW, F.lit(False)))
    rows = rows.withColumn("_mates", F.count_if("narrow").over(Window.partitionBy(*KEY, "_edge")))
    over = (x0 < middle) & (middle < x1) & (F.abs((x0 + x1) / 2 - middle) <= width * CENTRED)
    return rows.withColumn("narrow", F.col("narrow") & ~(over & (F.col("_mates") < LEAST_LINES))).drop("_mates")


def narrow_lines(lines: DataFrame, page: list[str]) -> DataFrame:
    """(page, x0, x1, left, right, narrow): which lines tell columns apart: well under the page's width, and not centred on it.

    A line over the middle counts all the same if others share its left edge.
    ``left`` and ``right`` are the page's. Lines without a place go.
    """
    return _judged(_paged(lines, page), parts_for(lines)).select("_page.*", "x0", "x1", "left", "right", "narrow")


def _allowed(n: Column) -> Column:
    return F.greatest(F.lit(NOISE_LEAST), F.floor(n * NOISE))


def _gaps(narrow: DataFrame) -> DataFrame:
    """(``KEY``, gutter, left, right, n): middles of bands that next to no narrow line covers.

    A sweep over the ends of the lines: each counts up at its first point and
    down behind its last, at one point first down, so that no count between
    is over both of those around it. A page's first line brings its first point.
    """
    whole = Window.partitionBy(*KEY)
    rows = narrow.withColumns({"n": F.count(F.lit(1)).over(whole), "_i": F.row_number().over(whole.orderBy("_edge"))})
    rows = rows.where((F.col("right") > F.col("left")) & (F.col("n") >= 2 * LEAST_LINES))
    first = F.greatest(F.lit(0), F.floor(F.col("x0") - F.col("left")) + 1).cast("int")
    last = F.floor(F.col("x1") - F.col("left")).cast("int")
    event = lambda at, step: F.struct(at.alias("cell"), F.lit(step).alias("step"))
    none = F.array().cast("array<struct<cell:int,step:int>>")
    ends = F.when(first <= last, F.array(event(first, 1), event(last + 1, -1))).otherwise(none)
    start = F.when(F.col("_i") == 1, F.array(event(F.lit(0), 0))).otherwise(none)
    steps = rows.select(*KEY, "left", "right", "n", F.inline(F.concat(ends, start)))
    w = whole.orderBy("cell", "step")
    runs = steps.withColumns({"_count": F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "_to": F.lead("cell").over(w)})
    width = F.col("right") - F.col("left")
    lo, hi = F.floor(width * SEARCH), F.floor(width * (1 - SEARCH)) + 1
    cells = (F.floor(width) + 2).cast("int")
    runs = runs.withColumns({"_from": F.greatest("cell", lo), "_to": F.least(F.coalesce("_to", cells), hi), "_full": F.col("_count") > _allowed(F.col("n"))})
    runs = runs.withColumn("_band", F.sum(F.col("_full").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where("NOT _full AND _from < _to")
    bands = runs.groupBy(*KEY, "_band", "left", "right", "n").agg(F.min("_from").alias("_from"), F.max("_to").alias("_to"))
    return bands.where(F.col("_to") - F.col("_from") >= LEAST_GAP).select(*KEY, (F.col("left") + (F.col("_from") + F.col("_to")) / 2).alias("gutter"), "left", "right", "n")


def _fills(side: str, width: Column) -> Column:
    """Whether the lines on one side look like a column: enough of them, and half of them at least over half its width."""
    return (F.col(f"_n_{side}") >= F.greatest(F.lit(LEAST_LINES), F.col("n") * LEAST_SHARE)) & (2 * F.col(f"_w_{side}") >= F.col(f"_n_{side}")) & (width > 0)


def _standing(narrow: DataFrame, gaps: DataFrame) -> DataFrame:
    """The ``gaps`` with columns on both sides, and ``_open``: whether others of the page went, so that these must be looked at again."""
    w = Window.partitionBy(*KEY).orderBy("gutter")
    near = gaps.select(*KEY, "gutter", "left", "right", "n", F.coalesce(F.lag("gutter").over(w), F.col("left")).alias("_lo"), F.coalesce(F.lead("gutter").over(w), F.col("right")).alias("_hi"))
    met = narrow.select(*KEY, "x0", "x1").join(near, KEY)
    west = (F.col("x0") >= F.col("_lo") - 1) & (F.col("x1") <= F.col("gutter"))
    east = (F.col("x0") >= F.col("gutter")) & (F.col("x1") <= F.col("_hi") + 1)
    wide = {"w": F.col("gutter") - F.col("_lo"), "e": F.col("_hi") - F.col("gutter")}
    counts = [c for side, here in (("w", west), ("e", east)) for c in (F.count_if(here).alias(f"_n_{side}"), F.count_if(here & (F.col("x1") - F.col("x0") >= wide[side] * LEAST_FILL)).alias(f"_w_{side}"))]
    sums = met.groupBy(*KEY, "gutter", "left", "right", "n", "_lo", "_hi").agg(*counts)
    sums = sums.withColumn("_good", _fills("w", wide["w"]) & _fills("e", wide["e"]))
    sums = sums.withColumn("_open", F.count_if(~F.col("_good")).over(Window.partitionBy(*KEY)) > 0)
    return sums.where("_good").select(*KEY, "gutter", "left", "right", "n", "_open")


def gutters(lines: DataFrame, page: list[str]) -> DataFrame:
    """(page, gutters): for each page with columns the x of the gaps between them, from left to right.

    A gap stays while the stretches on both sides of it look like columns. With
    one gone its neighbours' stretches widen, so pages that lost some and kept
    others are looked at again, and only those: at most as often as a page has
    gaps. The lines are dealt by page once for all, and once more, without the
    pages that are settled, if any are not; each round's outcome is checkpointed.

    Pages of one column, without lines or with fewer than six narrow ones have no row. Null pages
    are a page of their own, repeated lines count each. Ties don't matter. No lines give no rows.
    """
    rows, parts = _paged(lines, page), parts_for(lines)
    narrow = _judged(rows, parts).where("narrow")
    found = cut_lineage(_standing(narrow, _gaps(narrow)))
    settled, left = found.where("NOT _open"), found.where("_open")
    narrow = None
    while left.count():
        if narrow is None:
            narrow = cut_lineage(_judged(rows.join(_small(left.select(*KEY).distinct()), KEY, "left_semi"), parts).where("narrow").select(*KEY, "x0", "x1"))
        found = cut_lineage(_standing(narrow, left))
        settled, left = settled.unionByName(found.where("NOT _open")), found.where("_open")
    return settled.groupBy(*KEY).agg(F.array_sort(F.collect_list("gutter")).alias("gutters")).select("_page.*", "gutters")


def _vote(layouts: tuple, given) -> tuple:
    """The number of the first layout with as many gaps, each near enough, or of a new one."""
    mine = tuple(given)
    for i, known in enumerate(layouts):
        if len(known) == len(mine) and all(abs(a - b) <= SAME_LAYOUT for a, b in zip(known, mine, strict=True)):
            return layouts, i
    return (*layouts, mine), len(layouts)


def document_gutters(found: DataFrame, doc: str, page: str) -> DataFrame:
    """(doc, gutters, pages): of the pages' gutters the layout that most pages of a document have, if two at least have it.

    Pages are gone through in order; one whose gaps are within 8 points of
    those of an earlier layout's first page counts for it. Of equally frequent
    layouts the earlier stands. A document's state is its layouts alone. Null documents are
    one; ties in ``page`` go by the gaps.
    """
    voted = scan(found.select(doc, page, "gutters"), [doc], [page, "gutters"], "_layout", "int", tuple, _vote, ["gutters"])
    sums = voted.groupBy(doc, "_layout").agg(F.count(F.lit(1)).alias("pages"), F.min_by("gutters", F.struct(page, "gutters")).alias("gutters"))
    best = sums.groupBy(doc).agg(F.max(F.struct("pages", -F.col("_layout"), "gutters")).alias("b"))
    return best.select(doc, "b.gutters", "b.pages").where("pages >= 2")


def crosses(x0: Column, x1: Column, given: Column) -> Column:
    return F.exists(given, lambda g: (x0 < g - TOLERANCE) & (x1 > g + TOLERANCE))


def column_of(x0: Column, x1: Column, given: Column) -> Column:
    """A line's column from 0, or -1 if it crosses a gap; all in column 0 where there are none."""
    inside = F.size(F.filter(given, lambda g: (x0 + x1) / 2 > g))
    return F.when(given.isNull(), 0).when(crosses(x0, x1, given), -1).otherwise(inside)


def with_gutters(lines: DataFrame, doc: str, page: str) -> DataFrame:
    """``lines`` with ``gutters`` and ``borrowed``: their page's own gaps, or else the document's if they fit the page; null: one column.

    They fit unless over half of the page's lines cross them, or more narrow
    lines than a page's noise. Nulls as in ``gutters``; lines without a place
    tell nothing of their page, but stay. Rows come dealt by ``KEY``, which
    stands for both keys.
    """
    own = cut_lineage(gutters(lines, [doc, page]))
    shared = cut_lineage(document_gutters(own, doc, page).select(doc, F.col("gutters").alias("_shared")))
    # a document's layout goes to its lines where they are: dealt by document they would make few tasks
    rows = _judged(_beside(lines, _small(shared), [doc]).select("*", *_key([doc, page])), parts_for(lines))
    over = F.coalesce(crosses(F.col("x0"), F.col("x1"), F.col("_shared")), F.lit(False))
    whole = Window.partitionBy(*KEY)
    sums = {"_n": F.count_if(F.col("x0").isNotNull() & F.col("x1").isNotNull()), "_narrow": F.count_if("narrow"), "_wide": F.count_if(over), "_over": F.count_if(over & F.col("narrow"))}
    rows = rows.withColumns({k: c.over(whole) for k, c in sums.items()})
    fits = F.col("_shared").isNotNull() & (F.col("_n") > 0) & (F.col("_wide") <= F.col("_n") * WIDEST) & (F.col("_over") <= _allowed(F.col("_narrow")))
    rows = rows.join(own.select(*_key([doc, page]), F.col("gutters").alias("_own")), KEY, "left")
    return rows.select(*lines.columns, *KEY, F.coalesce("_own", F.when(fits, F.col("_shared"))).alias("gutters"), (F.col("_own").isNull() & fits).alias("borrowed"))


def page_gutters(lines: DataFrame, doc: str, page: str) -> DataFrame:
    """(doc, page, gutters, borrowed) of every page with lines that have a place, as ``with_gutters`` tells them."""
    rows = with_gutters(lines.select(doc, page, "x0", "x1").where("x0 IS NOT NULL AND x1 IS NOT NULL"), doc, page)
    return rows.groupBy(*KEY).agg(F.first("gutters").alias("gutters"), F.first("borrowed").alias("borrowed")).select("_page.*", "gutters", "borrowed")
