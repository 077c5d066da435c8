"""Columns of pages made of order lines: a part is a page, its lines stand in two columns, or across the page for each fifth part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import columns, layout
from .registry import query, table

BOXES = """WITH b AS (SELECT l_partkey % 20 AS doc, l_partkey AS page,
  50.0 + CASE WHEN l_partkey % 5 = 0 THEN 0 ELSE 260 * (l_linenumber % 2) END + round(l_discount * 50) AS x0,
  CASE WHEN l_partkey % 5 = 0 THEN 420 ELSE 180 + l_quantity END AS w FROM lineitem), l AS (SELECT doc, page, x0::DOUBLE AS x0, (x0 + w)::DOUBLE AS x1 FROM b)"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = F.col("l_partkey") % 5 == 0
    x0 = 50.0 + F.when(wide, 0).otherwise(260 * (F.col("l_linenumber") % 2)) + F.round(F.col("l_discount") * 50)
    y0 = F.col("l_orderkey") * 1.0
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 20).alias("doc"), F.col("l_partkey").alias("page"), x0.alias("x0"), y0.alias("y0"), F.when(wide, 420).otherwise(180 + F.col("l_quantity")).alias("w"), F.col("l_extendedprice").cast("string").alias("text"))
    return rows.withColumns({"x1": F.col("x0") + F.col("w"), "y1": F.col("y0") + 1}).drop("w")


@query(BOXES + """,
s AS (SELECT page, min(x0) AS a, max(x1) AS z FROM l GROUP BY page),
e AS (SELECT l.*, a, z, round_even(x0, 0) AS edge, x1 - x0 < (z - a) * 0.6 AS slim FROM l JOIN s USING (page)),
m AS (SELECT page, edge, count(*) AS mates FROM e WHERE slim GROUP BY page, edge),
n AS (SELECT e.page, x0, x1, a, z FROM e JOIN m USING (page, edge) WHERE slim AND NOT (x0 < (a + z) / 2 AND (a + z) / 2 < x1 AND abs((x0 + x1) / 2 - (a + z) / 2) <= (z - a) * 0.05 AND mates < 3)),
p AS (SELECT page, a, z, count(*) AS n, greatest(2, floor(count(*) * 0.1)) AS noise FROM n GROUP BY page, a, z HAVING count(*) >= 6 AND z > a),
c AS (SELECT page, unnest(generate_series(floor((z - a) * 0.15)::INT, floor((z - a) * 0.85)::INT)) AS cell FROM p),
k AS (SELECT c.page, cell, count(n.x0) AS lines FROM c LEFT JOIN n ON n.page = c.page AND greatest(0, floor(x0 - a) + 1) <= cell AND floor(x1 - a) >= cell GROUP BY ALL),
i AS (SELECT page, cell, cell - row_number() OVER (PARTITION BY page ORDER BY cell) AS island FROM k JOIN p USING (page) WHERE lines <= noise),
g AS (SELECT page, min(a) + (min(cell) + max(cell) + 1) / 2.0 AS gutter, any_value(a) AS a, any_value(z) AS z, any_value(n) AS n FROM i JOIN p USING (page) GROUP BY page, island HAVING count(*) >= 6),
f AS (SELECT g.page, gutter, g.a, g.z, g.n, count(*) FILTER (x1 <= gutter) AS w, count(*) FILTER (x0 >= gutter) AS e,
  list_sort(list(x1 - x0) FILTER (x1 <= gutter)) AS ws, list_sort(list(x1 - x0) FILTER (x0 >= gutter)) AS es FROM g JOIN n USING (page) GROUP BY g.page, gutter, g.a, g.z, g.n)
SELECT page, 1 AS n_gutters, gutter::DOUBLE AS gutter FROM f WHERE w >= greatest(3, n * 0.15) AND e >= greatest(3, n * 0.15)
  AND ws[w // 2 + 1] >= (gutter - a) * 0.5 AND es[e // 2 + 1] >= (z - gutter) * 0.5""")
def page_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gaps between columns of every page that has any."""
    found = columns.gutters(_lines(spark, sf_dir), ["page"])
    return found.select("page", F.size("gutters").alias("n_gutters"), F.explode("gutters").alias("gutter"))


@query()
def document_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The layout that most pages of each document share."""
    found = columns.gutters(_lines(spark, sf_dir), ["doc", "page"])
    return columns.document_gutters(found, "doc", "page").select("doc", F.get("gutters", F.lit(0)).alias("gutter"), "pages")


@query()
def column_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line's column and place in reading order, by gaps that the pages or their documents tell."""
    rows = layout.reading_order(columns.with_gutters(_lines(spark, sf_dir), "doc", "page"), columns.KEY, "gutters")
    return rows.select("doc", "page", "text", "x0", "y0", "band", "column", "place", "borrowed")
