"""Pieces of documents looked up in their own texts, as they are and after edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import letters_only
from ..operators import places
from .registry import query, table

PIECE, PAGE = 400, 1500


def _pieces(docs: DataFrame) -> DataFrame:
    """(doc_id, piece, text): texts in pieces of ``PIECE`` characters, a text without any as one empty piece."""
    cut = F.when(F.col("text") == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)))
    return docs.select("doc_id", F.posexplode_outer(cut).alias("piece", "text"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


@query("""WITH t AS (SELECT doc_id, text, length(text) AS n, greatest(1, least(24, length(text) // 16)) AS k FROM documents WHERE length(text) >= 4)
SELECT doc_id, i::INT AS probe, CASE WHEN n <= 16 THEN text ELSE substring(text, CASE WHEN k = 1 THEN 0 ELSE round_even(i * ((n - 16)::DOUBLE / (k - 1)), 0)::BIGINT END + 1, 16) END AS said
FROM t, LATERAL (SELECT unnest(generate_series(0, CASE WHEN n <= 16 THEN 0 ELSE k - 1 END)) AS i) x""")
def text_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The probes of every document's text."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(places.probes(F.col("text"))).alias("probe", "said"))


@query()
def located_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every piece of every document stands in it."""
    docs = _documents(spark, sf_dir)
    return places.locate(_pieces(docs), docs, "doc_id", "piece").select("doc_id", "piece", "start", "end")


@query()
def edited_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same after each piece lost its first words and had letters changed; ``near`` tells whether it was found where it was cut."""
    docs = _documents(spark, sf_dir)
    pieces = _pieces(docs)
    edited = F.regexp_replace(F.regexp_replace("text", "^(\\S+\\s+){0,3}", "new words here "), "[qvwx]", "")
    found = places.locate(pieces.withColumn("text", edited), docs, "doc_id", "piece").select("doc_id", "piece", "start", "end")
    truth = places.locate(pieces, docs, "doc_id", "piece").select("doc_id", "piece", F.col("start").alias("was"))
    near = F.col("start").between(F.col("was") - 40, F.col("was") + 60)
    return found.join(truth, ["doc_id", "piece"]).select("doc_id", "piece", "start", "was", F.coalesce(near, F.col("was").isNull() & F.col("start").isNull()).alias("near"))


@query()
def piece_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last page of every piece, pages being ``PAGE`` letters long."""
    docs = _documents(spark, sf_dir)
    size = F.greatest(F.ceil(F.length(letters_only(F.col("text"))) / PAGE), F.lit(1)).cast("int")
    starts = docs.select("doc_id", F.explode(F.sequence(F.lit(1), size)).alias("page")).select("doc_id", "page", ((F.col("page") - 1) * PAGE).alias("start"))
    return places.pages_of_pieces(places.locate(_pieces(docs), docs, "doc_id", "piece"), starts, "doc_id", "piece")
