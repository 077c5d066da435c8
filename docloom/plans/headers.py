"""Running headers of reports that are made of documents: forty documents are a report's pages, with a header and a footer each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import headers
from .registry import query, table


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(report, page, y0, y1, height, text): a header whose wording changes from page to page, the document's lines, a footer, a page number."""
    docs = table(spark, sf_dir, "documents")
    kind = F.element_at(F.array(*map(F.lit, ("draft", "second draft", "revised", "final"))), (F.col("doc_id") % 4 + 1).cast("int"))
    report = F.floor(F.col("doc_id") / 40)
    head = F.concat(F.lit("Quarterly report "), report.cast("string"), F.lit(" on "), F.coalesce("source", F.lit("")), F.lit(" - "), kind)
    foot = F.concat(F.lit("Office of papers, room "), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, " (annex)").otherwise(""))
    said = F.concat(F.array(head), F.split(F.coalesce("text", F.lit("")), "\n"), F.array(foot, F.col("doc_id").cast("string")))
    # the lines are counted before they part: beside the generator the text would be split anew for each line
    whole = docs.select(report.alias("report"), F.col("doc_id").alias("page"), said.alias("said")).withColumn("n", F.size("said"))
    rows = whole.select("report", "page", "n", F.posexplode_outer("said").alias("at", "text"))
    # ten points a line, the first and the last two in the margins
    top = F.when(F.col("at") == 0, 0.0).when(F.col("at") >= F.col("n") - 2, 950.0).otherwise(500.0)
    return rows.select("report", "page", "at", top.alias("y0"), (top + 10).alias("y1"), F.lit(1000.0).alias("height"), "text")


@query()
def running_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every form of every report's headers and footers, the pages it stands on in that or a similar form, and its chief form."""
    lines = _lines(spark, sf_dir)
    found = headers.running_headers(lines.where("y0 <> 500"), "report", "page", "text")
    return headers.header_forms(found, "report").join(found, ["report", "key"]).select("report", "key", "form", "pages")


@query("""WITH d AS (SELECT doc_id // 40 AS report, doc_id AS page, coalesce(text, '') AS text FROM documents),
n AS (SELECT report, count(DISTINCT page) AS pages FROM d GROUP BY report)
SELECT report, page, (len(string_split(text, chr(10))) + CASE WHEN pages < 3 THEN 2 ELSE 0 END)::BIGINT AS n_lines FROM d JOIN n USING (report)""")
def pages_without_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are left of each page without headers, footers and page numbers."""
    lines = headers.without_headers(_lines(spark, sf_dir), "report", "page", "text")
    return lines.groupBy("report", "page").agg(F.count(F.lit(1)).alias("n_lines"))
