"""Customers written as CSV files of a hundred in three encodings, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import tabular
from .registry import query, table

NAMES = ["c_custkey", "c_name", "c_acctbal", "c_mktsegment", "note"]


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    note = F.when(F.col("c_custkey") % 3 > 0, F.concat(F.lit('é "'), "c_name", F.lit('",\nline '), F.col("c_custkey").cast("string")))
    line = tabular.csv_line([F.col("c_custkey"), F.col("c_name"), F.col("c_acctbal"), F.col("c_mktsegment"), note])
    part = F.floor(F.col("c_custkey") / 100).cast("int").alias("part")
    rows = c.select(part, "c_custkey", line.alias("line")).groupBy("part").agg(F.array_sort(F.collect_list(F.struct("c_custkey", "line"))).alias("lines"))
    text = F.concat(F.lit(",".join(NAMES) + "\n"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n"))
    coded = F.when(F.col("part") % 3 == 0, F.encode(text, "UTF-8")).when(F.col("part") % 3 == 1, F.encode(text, "UTF-16LE")).otherwise(F.encode(text, "UTF-16"))
    return rows.select(F.concat(F.col("part").cast("string"), F.lit(".csv")).alias("path"), coded.alias("content"))


@query("""SELECT c_custkey, c_name, round(c_acctbal, 2) AS c_acctbal, c_mktsegment, CASE WHEN c_custkey % 3 > 0 THEN 'é "' || c_name || '",' || chr(10) || 'line ' || c_custkey ELSE 'null' END AS note FROM customer""")
def customers_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer, read from a file."""
    cells = tabular.cells_of(tabular.read_rows(_files(spark, sf_dir)))
    r = tabular.records(cells)
    kinds = {"c_custkey": "bigint", "c_acctbal": "double"}
    return r.select(*[(F.round(F.col("record")[n].cast("double"), 2) if n == "c_acctbal" else F.col("record")[n].cast(kinds.get(n, "string"))).alias(n) for n in NAMES])


@query("""WITH c AS (SELECT *, floor(c_custkey / 100)::INT || '.csv' AS path, CASE WHEN c_custkey % 3 > 0 THEN 'é "' || c_name || '",' || chr(10) || 'line ' || c_custkey END AS note FROM customer)
SELECT path, 0 AS col, 'c_custkey' AS name, 'BIGINT' AS type, count(*) AS n, 0::BIGINT AS nulls FROM c GROUP BY path UNION ALL SELECT path, 1, 'c_name', 'VARCHAR(' || max(length(c_name)) + 10 || ')', count(*), 0 FROM c GROUP BY path
UNION ALL SELECT path, 2, 'c_acctbal', 'FLOAT', count(*), 0 FROM c GROUP BY path UNION ALL SELECT path, 3, 'c_mktsegment', 'VARCHAR(' || max(length(c_mktsegment)) + 10 || ')', count(*), 0 FROM c GROUP BY path
UNION ALL SELECT path, 4, 'note', 'VARCHAR(' || max(length(coalesce(note, 'null'))) + 10 || ')', count(*), count(*) FILTER (note IS NULL) FROM c GROUP BY path""")
def column_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inferred types of every file's columns."""
    return tabular.infer_types(tabular.cells_of(tabular.read_rows(_files(spark, sf_dir)))).drop("sheet")
