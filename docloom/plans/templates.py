"""Queries of templates: slots, fields, repeated groups, numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import templates
from .registry import query, table


@query("""
WITH a AS (SELECT l_orderkey, l_linenumber, l_suppkey, (l_suppkey % 3 + 1)::INT AS level FROM lineitem),
b AS (SELECT *, count(CASE WHEN level < 2 THEN 1 END) OVER w AS two, count(CASE WHEN level < 3 THEN 1 END) OVER w AS three
      FROM a WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey ROWS UNBOUNDED PRECEDING)),
c AS (SELECT *, CASE level WHEN 1 THEN 0 WHEN 2 THEN two ELSE three END AS above FROM b)
SELECT l_orderkey, l_linenumber, level,
  row_number() OVER (PARTITION BY l_orderkey, level, above ORDER BY l_linenumber, l_suppkey) AS number FROM c
""")
def order_line_numbers(spark, sf_dir):
    # lines that tie have one supplier, so one level: which of them comes first doesn't show
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", (F.col("l_suppkey") % 3 + 1).cast("int").alias("level"))
    return templates.level_numbers(lines, "l_orderkey", ["l_linenumber", "l_suppkey"], "level").drop("l_suppkey")
