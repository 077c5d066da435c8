"""Documents as tables of their lines, cut and packed under a budget, and as chunks merged under their sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import packing
from .registry import query, table

LIMIT = 600


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, row, cell, text): each line of a document with its number before it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("row", "line"))
    number = F.struct(F.lit(0).alias("cell"), (F.col("row") + 1).cast("string").alias("text"))
    return docs.select("doc_id", "row", F.inline(F.array(number, F.struct(F.lit(1).alias("cell"), F.col("line").alias("text")))))


@query("""SELECT doc_id, md5(coalesce(text, '')) AS form FROM documents""")
def wide_rows_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, put together from the pieces of its lines."""
    pieces = packing.split_wide_rows(_cells(spark, sf_dir), ["doc_id"], LIMIT)
    lines = packing.whole_rows(pieces, ["doc_id"]).where("cell = 1")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("row", "text"))), lambda x: x["text"])
    return lines.groupBy("doc_id").agg(F.md5(F.array_join(texts, "\n")).alias("form"))


@query()
def wide_row_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of every document's table of lines: rows, characters and the title that says which of how many it is."""
    pieces = packing.split_wide_rows(_cells(spark, sf_dir), ["doc_id"], LIMIT)
    rows = pieces.groupBy("doc_id", "row", "piece").agg(F.sum(F.length("text")).alias("size")).withColumn("title", F.concat(F.lit("Document "), F.col("doc_id").cast("string")))
    parts = packing.table_parts(rows, ["doc_id"], ["row", "piece"], LIMIT + 100, head=None, title="title")
    return parts.groupBy("doc_id", "part", "parts", "prefix").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("size").alias("n_char"))


@query()
def merged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document merged while they have room in a chunk and begin with the same kind of character."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("at", "text"))
    kind = F.array(F.when(F.col("text").rlike("^\\p{Lu}"), "capital").when(F.col("text").rlike("^[0-9]"), "number").otherwise("other"))
    merged = packing.merge_chunks(lines.withColumn("path", kind), "doc_id", "at", limit=LIMIT)
    return merged.select("doc_id", "i", F.get("path", F.lit(0)).alias("kind"), "n", F.md5("text").alias("form"))
