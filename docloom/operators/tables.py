"""Tables with merged cells: where each cell stands, the grid it covers, and the table as HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import dealt, scan


def _place(state: tuple, row: int, at_row: int, at_col: int, row_span: int, col_span: int) -> tuple:
    """Where a cell starts: at its address, or in the next place of its row that no cell before it covers.

    The state is the row, the place after the cell before, and the rectangles
    that still reach into this row or below.
    """
    now, cursor, rects = state
    if row != now:
        now, cursor, rects = row, 0, [r for r in rects if r[1] > row]
    r, c = (at_row if at_row >= 0 else row), (at_col if at_col >= 0 else cursor)
    if at_row < 0 and at_col < 0:
        while found := [x[3] for x in rects if x[0] <= r < x[1] and x[2] <= c < x[3]]:
            c = max(found)
    rect = (r, r + row_span, c, c + col_span)
    # a cell that ends with its row is behind the cursor already, unless an address can lead back before it
    return (now, c + col_span, [*rects, rect]), (r, c)


def place_cells(cells: DataFrame, keys: list[str], row: str = "row", cell: str = "cell", row_span: str = "row_span", col_span: str = "col_span", at_row: str | None = None, at_col: str | None = None, parts: int | None = None) -> DataFrame:
    """``cells`` with ``top``, ``left``, ``height`` and ``width``: the rectangle that each cell covers in its table.

    ``keys`` name a table, ``row`` and ``cell`` give the order in it. A cell
    stands at its address (``at_row``, ``at_col``) if it has one, else right
    after the cell before it in its row, past all that cells above or before it cover.
    Rows are streamed in order, so a table of any length needs only the
    rectangles that reach into the row at hand.

    Null spans and those under 1 are 1; null or negative addresses are none, and where only
    one half is given the other is the row or the place after the cell before. Null keys are a table of
    their own. Cells that tie in ``row`` and ``cell`` go by their spans. An empty table gives an empty one.
    """
    span = lambda c: F.greatest(F.coalesce(F.col(c).cast("int"), F.lit(1)), F.lit(1))
    address = lambda c: F.lit(-1) if c is None else F.coalesce(F.col(c).cast("int"), F.lit(-1))
    rows = cells.withColumns({"height": span(row_span), "width": span(col_span), "_r": F.coalesce(F.col(row).cast("int"), F.lit(0)), "_ar": address(at_row), "_ac": address(at_col)})
    placed = scan(rows, keys, ["_r", cell, "height", "width"], "_at", "struct<r:int,c:int>", lambda: (-1, 0, []), _place, ["_r", "_ar", "_ac", "height", "width"], parts)
    return placed.withColumns({"top": F.col("_at.r"), "left": F.col("_at.c")}).drop("_at", "_r", "_ar", "_ac")


def merge_down(cells: DataFrame, keys: list[str], row: str = "row", cell: str = "cell", col_span: str = "col_span", merge: str = "merge") -> DataFrame:
    """The same for tables whose cells say ``restart`` and ``continue``: only anchors stay, as tall as their run.

    A cell starts after the spans of those before it in its row. An anchor
    that says ``restart`` covers the rows right below it that have a
    ``continue`` at its column. Cells that continue nothing are dropped too, as they show nothing. Nulls as in ``place_cells``.
    """
    width = F.greatest(F.coalesce(F.col(col_span).cast("int"), F.lit(1)), F.lit(1))
    rows = cells.withColumns({"width": width, "top": F.coalesce(F.col(row).cast("int"), F.lit(0)), "_m": F.coalesce(F.col(merge), F.lit(""))})
    line = Window.partitionBy(*keys, "top").orderBy(cell, "width").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("left", F.coalesce(F.sum("width").over(line), F.lit(0)).cast("int"))
    down = Window.partitionBy(*keys, "left").orderBy("top")
    fresh = (F.col("_m") != "continue") | F.coalesce(F.lag("top").over(down) != F.col("top") - 1, F.lit(True))
    rows = rows.withColumn("_run", F.sum(fresh.cast("int")).over(down))
    tall = F.count(F.lit(1)).over(Window.partitionBy(*keys, "left", "_run")).cast("int")
    rows = rows.withColumn("height", F.when(F.col("_m") == "restart", tall).otherwise(1))
    return rows.where(F.col("_m") != "continue").drop("_m", "_run")


def grid(placed: DataFrame, keys: list[str], cell: str = "cell", parts: int | None = None) -> DataFrame:
    """(keys, row, col, is_anchor, cell): each place that a cell covers, once; ``cell`` is the anchor's, null where a place is only covered.

    Of cells with the same address the last in order counts.
    """
    across = F.explode(F.sequence(F.col("left"), F.col("left") + F.col("width") - 1))
    down = F.explode(F.sequence(F.col("top"), F.col("top") + F.col("height") - 1))
    spread = placed.select(*keys, "top", "left", F.col(cell).alias("_c"), "width", down.alias("row")).select("*", across.alias("col"))
    anchor = (F.col("row") == F.col("top")) & (F.col("col") == F.col("left"))
    spread = spread.repartition(parts, *keys) if parts else spread
    return spread.groupBy(*keys, "row", "col").agg(F.max(anchor).alias("is_anchor"), F.max(F.when(anchor, F.col("_c"))).alias("cell"))


def escaped(text: Column) -> Column:
    """Text of a cell as HTML: lines parted by ``<br>``."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\n", "<br>")):
        text = F.replace(text, F.lit(sign), F.lit(entity))
    return text


def _tag(body: Column) -> Column:
    name = F.when(F.col("top") == 0, F.lit("th")).otherwise(F.lit("td"))
    span = lambda name, c: F.when(F.col(c) > 1, F.concat(F.lit(f' {name}="'), F.col(c).cast("string"), F.lit('"'))).otherwise(F.lit(""))
    return F.concat(F.lit("<"), name, span("rowspan", "height"), span("colspan", "width"), F.lit(">"), body, F.lit("</"), name, F.lit(">"))


def table_html(placed: DataFrame, keys: list[str], text: str = "text", cell: str = "cell", fill: bool = True, parts: int | None = None) -> DataFrame:
    """(keys, n_rows, n_cols, html): each table on one line, its first row as heads.

    Cells stand at their places, and places that no cell covers are empty
    cells (``fill``; without it such places are left out, and rows without
    cells too). Cells are dealt by table once and worked out once; sums by place and row come before
    a table's rows meet, as its text does. ``parts`` is the number of partitions, if not the session's.
    """
    body = F.struct(_tag(escaped(F.col(text))).alias("x"))
    reach = F.explode(F.sequence(F.col("top"), F.col("top") + F.col("height") - 1)) if fill else F.col("top")
    ends = [(F.col("top") + F.col("height")).alias("_bottom"), (F.col("left") + F.col("width")).alias("_right")]
    cells = placed.select(*keys, "left", "width", "top", F.col(cell).alias("_cell"), body.alias("_body"), *ends)
    cells = dealt(cells.withColumn("height", F.col("_bottom") - F.col("top")), keys, parts).select(*keys, "left", "width", "top", "_cell", "_body", "_bottom", "_right", reach.alias("row"))
    own = F.col("row") == F.col("top")
    places = cells.groupBy(*keys, "row", "left").agg(
        F.max("width").alias("width"), F.max_by(F.when(own, F.col("_body")), F.when(own, F.col("_cell"))).alias("_body"), F.max("_bottom").alias("_bottom"), F.max("_right").alias("_right")
    )
    place = F.struct("left", "width", F.col("_body.x").alias("_html"))
    rows = places.groupBy(*keys, "row").agg(F.collect_list(place).alias("_places"), F.max("_bottom").alias("_bottom"), F.max("_right").alias("_right"))
    every = rows.groupBy(*keys).agg(F.max("_bottom").alias("n_rows"), F.max("_right").alias("n_cols"), F.collect_list(F.struct("row", "_places")).alias("_rows"))

    def line(row: Column, shown: Column) -> Column:
        said = F.filter(shown, lambda c: c["_html"].isNotNull())
        said = F.transform(said, lambda c: F.struct(c["left"].alias("left"), c["_html"].alias("_html")))
        if fill:
            taken = F.flatten(F.transform(shown, lambda c: F.sequence(c["left"], c["left"] + c["width"] - 1)))
            blank = F.when(row == 0, "<th></th>").otherwise("<td></td>")
            free = F.array_except(F.sequence(F.lit(0), F.col("n_cols") - 1), taken)
            said = F.concat(said, F.transform(free, lambda c: F.struct(c.alias("left"), blank.alias("_html"))))
        return F.concat(F.lit("<tr>"), F.array_join(F.transform(F.array_sort(said), lambda c: c["_html"]), ""), F.lit("</tr>"))

    shown = F.transform("_rows", lambda r: F.struct(r["row"].alias("row"), line(r["row"], r["_places"]).alias("_row")))
    if fill:
        bare = F.array_except(F.sequence(F.lit(0), F.col("n_rows") - 1), F.transform("_rows", lambda r: r["row"]))
        none = F.array().cast("array<struct<left:int,width:int,_html:string>>")
        shown = F.concat(shown, F.transform(bare, lambda r: F.struct(r.alias("row"), line(r, none).alias("_row"))))
    html = F.concat(F.lit("<table><tbody>"), F.array_join(F.transform(F.array_sort(shown), lambda r: r["_row"]), ""), F.lit("</tbody></table>"))
    return every.select(*keys, "n_rows", "n_cols", html.alias("html"))


def _beside(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on keys, null keys alike."""
    other = right.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    same = F.lit(True)
    for i, k in enumerate(keys):
        same &= left[k].eqNullSafe(other[f"_k{i}"])
    return left.join(other, same, "left").drop(*[f"_k{i}" for i in range(len(keys))])
