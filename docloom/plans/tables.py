"""Tables with merged cells, made of order lines: a flag is merged over the lines that share it, statuses over columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import tables
from ..operators.ordered import dealt, parts_for
from .registry import query, table


def _parts(spark: SparkSession, sf_dir: str) -> int:
    return parts_for(table(spark, sf_dir, "lineitem"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with the number of their run of equal flags, dealt by order."""
    rows = dealt(table(spark, sf_dir, "lineitem"), ["l_orderkey"], _parts(spark, sf_dir)).select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_returnflag", "l_linestatus", F.col("l_quantity").cast("int").alias("n"))
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice")
    rows = rows.withColumn("row", (F.row_number().over(w) - 1).cast("int"))
    fresh = ~F.col("l_returnflag").eqNullSafe(F.lag("l_returnflag").over(w)) | (F.col("row") == 0)
    return rows.withColumn("fresh", fresh).withColumn("run", F.sum(F.col("fresh").cast("int")).over(w))


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells as an office file holds them, without addresses: the flag stands only in the first line of its run."""
    rows = _lines(spark, sf_dir)
    rows = rows.withColumn("tall", F.count(F.lit(1)).over(Window.partitionBy("l_orderkey", "run")).cast("int"))
    cell = lambda i, tall, wide, text: F.struct(F.lit(i).alias("cell"), tall.alias("row_span"), wide.alias("col_span"), text.cast("string").alias("text"))
    one = F.lit(1)
    wide = (F.col("l_linenumber") % 2 + 1).cast("int")
    every = F.filter(F.array(F.when(F.col("fresh"), cell(0, F.col("tall"), one, F.col("l_returnflag"))), cell(1, one, wide, F.col("l_linestatus")), cell(2, one, one, F.col("n"))), lambda c: c.isNotNull())
    return rows.select("l_orderkey", "row", F.inline(every))


BASE = """WITH l AS (SELECT l_orderkey, l_linenumber, l_returnflag AS f, l_linestatus AS s, l_quantity::INT AS n,
  (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) - 1)::INT AS "row" FROM lineitem),
m AS (SELECT *, CASE WHEN lag(f) OVER (PARTITION BY l_orderkey ORDER BY "row") IS NOT DISTINCT FROM f AND "row" > 0 THEN 0 ELSE 1 END AS fresh FROM l),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY l_orderkey ORDER BY "row") AS run, (l_linenumber % 2 + 1)::INT AS wide FROM m),
t AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey, run) AS tall FROM r),
p AS (SELECT l_orderkey, "row" AS top, 0 AS "left", tall AS height, 1 AS width, 0 AS cell, f AS text FROM t WHERE fresh = 1
  UNION ALL SELECT l_orderkey, "row", 1, 1, wide, 1, s FROM t UNION ALL SELECT l_orderkey, "row", 1 + wide, 1, 1, 2, n::VARCHAR FROM t)"""

HTML = """h AS (SELECT l_orderkey, top, "left", '<' || tag || CASE WHEN height > 1 THEN ' rowspan="' || height || '"' ELSE '' END || CASE WHEN width > 1 THEN ' colspan="' || width || '"' ELSE '' END || '>' || text || '</' || tag || '>' AS x
  FROM (SELECT *, CASE WHEN top = 0 THEN 'th' ELSE 'td' END AS tag FROM p)),"""


@query(BASE + """
SELECT l_orderkey, ("top" + i.i)::INT AS "row", ("left" + j.j)::INT AS col, i.i = 0 AND j.j = 0 AS is_anchor, CASE WHEN i.i = 0 AND j.j = 0 THEN cell END::INT AS cell
FROM p, LATERAL (SELECT unnest(generate_series(0, height - 1)) AS i) i, LATERAL (SELECT unnest(generate_series(0, width - 1)) AS j) j""")
def table_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place of every order's table, with the cell that stands or reaches there."""
    parts = _parts(spark, sf_dir)
    return tables.grid(tables.place_cells(_cells(spark, sf_dir), ["l_orderkey"], parts=parts), ["l_orderkey"], parts=parts)


@query(BASE + f""", {HTML}
z AS (SELECT l_orderkey, max(top + height)::INT AS n_rows, max("left" + width)::INT AS n_cols FROM p GROUP BY l_orderkey),
e AS (SELECT t.l_orderkey, "row" AS top, 2 + wide AS "left", CASE WHEN "row" = 0 THEN '<th></th>' ELSE '<td></td>' END AS x FROM t JOIN z USING (l_orderkey) WHERE 2 + wide < n_cols),
w AS (SELECT l_orderkey, top, '<tr>' || string_agg(x, '' ORDER BY "left") || '</tr>' AS x FROM (SELECT * FROM h UNION ALL SELECT * FROM e) GROUP BY l_orderkey, top)
SELECT l_orderkey, n_rows, n_cols, '<table><tbody>' || string_agg(x, '' ORDER BY top) || '</tbody></table>' AS html FROM w JOIN z USING (l_orderkey) GROUP BY ALL""")
def merged_table_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order's table as HTML, with the places that no cell covers as empty cells."""
    parts = _parts(spark, sf_dir)
    return tables.table_html(tables.place_cells(_cells(spark, sf_dir), ["l_orderkey"], parts=parts), ["l_orderkey"], parts=parts)


@query(BASE + f""", {HTML}
w AS (SELECT l_orderkey, top, '<tr>' || string_agg(x, '' ORDER BY "left") || '</tr>' AS x FROM h GROUP BY l_orderkey, top),
z AS (SELECT l_orderkey, max(top + height)::INT AS n_rows, max("left" + width)::INT AS n_cols FROM p GROUP BY l_orderkey)
SELECT l_orderkey, n_rows, n_cols, '<table><tbody>' || string_agg(x, '' ORDER BY top) || '</tbody></table>' AS html FROM w JOIN z USING (l_orderkey) GROUP BY ALL""")
def continued_table_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same tables from cells that say whether they restart or continue a merge downwards."""
    rows = _lines(spark, sf_dir)
    cell = lambda i, wide, merge, text: F.struct(F.lit(i).alias("cell"), wide.alias("col_span"), merge.cast("string").alias("merge"), text.cast("string").alias("text"))
    wide = (F.col("l_linenumber") % 2 + 1).cast("int")
    merge = F.when(F.col("fresh"), "restart").otherwise("continue")
    cells = F.array(cell(0, F.lit(1), merge, F.col("l_returnflag")), cell(1, wide, F.lit(None), F.col("l_linestatus")), cell(2, F.lit(1), F.lit(None), F.col("n")))
    placed = tables.merge_down(rows.select("l_orderkey", "row", F.inline(cells)), ["l_orderkey"])
    return tables.table_html(placed, ["l_orderkey"], fill=False, parts=_parts(spark, sf_dir))
