"""Letters of documents: a template file filled for each, and read back."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import containers, documents
from .registry import query, table


def _template() -> bytes:
    """A container of four paragraphs: one with a slot over two runs, one with a form field, and a group of two that can be repeated."""
    run = "<hp:run><hp:t>{}</hp:t></hp:run>"
    field = '<hp:run><hp:ctrl><hp:fieldBegin type="CLICK_HERE" name="source" guide="source"/></hp:ctrl><hp:t>source</hp:t><hp:ctrl><hp:fieldEnd/></hp:ctrl></hp:run>'
    lines = [run.format("No. {'i") + run.format("d'} of "), field, run.format("line1: {'line1'}"), run.format("{'line1 text', small}")]
    body = "".join(f"<hp:p>{x}</hp:p>" for x in lines)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("mimetype", "application/zip")
        z.writestr("Contents/section0.xml", f'<hp:sec xmlns:hp="urn:paragraph">{body}</hp:sec>')
    return out.getvalue()


def _letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The template for every document, and what goes into it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("none")).alias("source"), F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[\\s\\x00-\\x1F\\x7F]+", " ")).alias("text"))
    values = F.create_map(F.lit("id"), F.col("doc_id").cast("string"), F.lit("source"), F.col("source"), F.lit("line1"), F.lit("first"), F.lit("line1 text"), F.col("text"), F.lit("line2"), F.lit("second"), F.lit("line2 text"), F.concat(F.lit("end of "), F.col("doc_id").cast("string")))
    copies = F.create_map(F.lit("line"), (F.col("doc_id") % 2 + 1).cast("int"))
    return docs.select(F.concat(F.col("doc_id").cast("string"), F.lit(".hwpx")).alias("path"), F.lit(_template()).alias("content"), values.alias("values"), copies.alias("copies"), F.array(F.concat(F.lit("signed "), "source")).alias("blocks"))


@query("""WITH d AS (SELECT doc_id, coalesce(source, 'none') AS source, trim(regexp_replace(coalesce(text, ''), '[\\s\\x00-\\x1F\\x7F]+', ' ', 'g')) AS text FROM documents),
b AS (SELECT doc_id, 0 AS i, 'No. ' || doc_id || ' of' AS t FROM d UNION ALL SELECT doc_id, 1, source FROM d UNION ALL SELECT doc_id, 2, 'line1: first' FROM d UNION ALL SELECT doc_id, 3, text FROM d
  UNION ALL SELECT doc_id, 4, 'line1: second' FROM d WHERE doc_id % 2 = 1 UNION ALL SELECT doc_id, 5, 'end of ' || doc_id FROM d WHERE doc_id % 2 = 1 UNION ALL SELECT doc_id, 6, 'signed ' || source FROM d)
SELECT doc_id || '.hwpx' AS path, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS pos, md5(t) AS form FROM b WHERE t <> ''""")
def filled_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks of every document's letter, read back from its filled file."""
    return documents.read_blocks(containers.fill_files(_letters(spark, sf_dir))).select("path", "pos", F.md5("text").alias("form"))


@query("""SELECT doc_id || '.hwpx' AS path, 0::BIGINT AS missing, (CASE WHEN doc_id % 2 = 1 THEN 6 ELSE 0 END + 3)::BIGINT AS added, true AS passed FROM documents""")
def letter_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every letter has more or less than the template: its repeated group and the paragraph at its end."""
    letters = _letters(spark, sf_dir)
    return containers.integrity(letters, containers.fill_files(letters))
