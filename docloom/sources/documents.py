"""Document containers as ordered block tables, and tables as document files."""

from __future__ import annotations

import io
import itertools
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.tables import merge_down, place_cells, table_html

BLOCKS = "path string, pos int, section int, kind string, text string, problem string"
CELLS = "path string, pos int, row int, cell int, row_span int, col_span int, at_row int, at_col int, merge string, text string"


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, content, length, modificationTime) of each file under ``path``, in subfolders too."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
    return reader.load(path)


def engine_of(path: Column, content: Column) -> Column:
    """Which reader takes a file: by its ending, and for zip containers by its first bytes too."""
    ending = F.lower(F.regexp_extract(path, "\\.([A-Za-z0-9]+)$", 1))
    is_zip = F.substring(content, 1, 4) == F.lit(b"PK\x03\x04")
    return (
        F.when(ending.isin("docx", "hwpx") & is_zip, ending)
        .when(ending.isin("docx", "hwpx"), "not_a_zip")
        .when(ending.isin("md", "markdown"), "markdown")
        .when(ending.isin("txt", "csv", "tsv"), "text")
        .otherwise("unknown")
    )


def _tag(node) -> str:
    return node.tag.rpartition("}")[2]


def _text(node) -> str:
    return "".join(x.text or "" for x in node.iter() if _tag(x) == "t").strip()


def _pieces(root) -> Iterator[tuple]:
    """("paragraph", text) and ("table", its node) in document order; what a paragraph holds beside a table stays apart."""

    def inner(node) -> Iterator:
        for child in node:
            if _tag(child) == "tbl":
                yield child
            elif _tag(child) == "t":
                yield "".join(child.itertext())
            else:
                yield from inner(child)

    for child in root:
        if _tag(child) == "tbl":
            yield "table", child
        elif _tag(child) == "p":
            said = ""
            for x in [*inner(child), None]:
                if isinstance(x, str):
                    said += x
                    continue
                if said.strip():
                    yield "paragraph", said.strip()
                said = ""
                if x is not None:
                    yield "table", x
        else:
            yield from _pieces(child)


def _rows(table) -> list[list]:
    return [[c for c in r if _tag(c) == "tc"] for r in table if _tag(r) == "tr"]


def _block_text(kind: str, piece) -> tuple[str, str]:
    """A block's kind and text; a table is its rows, cells parted by bars, one of a single cell is a box around a paragraph."""
    if kind == "paragraph":
        return kind, piece
    rows = _rows(piece)
    return ("box" if [len(r) for r in rows] == [1] else kind), "\n".join(" | ".join(map(_text, r)) for r in rows)


def _sections(content: bytes) -> Iterator[tuple]:
    """(section, pos, kind, piece) of a container, pieces as ``_pieces`` gives them."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        parts = {n: int(m[1] or 0) for n in z.namelist() if (m := re.fullmatch(r"(?:Contents/section|word/document)(\d*)\.xml", n))}
        if not parts:
            raise KeyError("no_document_part")
        pos = 0
        for name in sorted(parts, key=parts.get):
            for kind, piece in _pieces(ElementTree.fromstring(z.read(name))):
                yield parts[name], pos, kind, piece
                pos += 1


def _blocks_of(path: str, content: bytes) -> Iterator[tuple]:
    try:
        for section, pos, kind, piece in _sections(content):
            yield path, pos, section, *_block_text(kind, piece), None
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError) as e:
        yield path, -1, -1, "problem", None, "no_document_part" if "no_document_part" in str(e) else type(e).__name__


def _number(given: str | None) -> int | None:
    return int(given) if given and re.fullmatch(r"-?\d{1,9}", given) else None


def _described(cell) -> dict[str, str | None]:
    """Spans and address of a cell as they are written in either kind of container."""
    out: dict[str, str | None] = {}
    for x in cell:
        if _tag(x) in ("cellAddr", "cellSpan", "tcPr"):
            out |= {k.rpartition("}")[2]: v for k, v in x.attrib.items()}
        if _tag(x) == "tcPr":
            for y in x:
                value = next((v for k, v in y.attrib.items() if k.rpartition("}")[2] == "val"), None)
                out[_tag(y)] = value if value is not None or _tag(y) != "vMerge" else "continue"
    return out


def _cell_text(cell) -> str:
    """Paragraphs of a cell by line; a table inside it is its rows, cells parted by bars."""
    return "\n".join(_block_text(kind, piece)[1] for kind, piece in _pieces(cell))


def _cells_of(path: str, content: bytes) -> Iterator[tuple]:
    try:
        for _, pos, kind, piece in _sections(content):
            if kind != "table":
                continue
            for r, row in enumerate(_rows(piece)):
                for c, cell in enumerate(row):
                    at = _described(cell)
                    spans = _number(at.get("rowSpan")), _number(at.get("colSpan") or at.get("gridSpan"))
                    yield path, pos, r, c, *spans, _number(at.get("rowAddr")), _number(at.get("colAddr")), at.get("vMerge"), _cell_text(cell)
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError):
        return  # read_blocks names the problem


def _parsed(files: DataFrame, parse, schema: str) -> DataFrame:
    """What ``parse`` gives for each container, in batches of some thousand rows."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            # small files share a batch
            rows = (row for path, content in zip(frame["path"], frame["content"], strict=True) for row in parse(path, content))
            while some := list(itertools.islice(rows, 5000)):
                yield pd.DataFrame(some, columns=names).astype(object)

    return files.where(engine_of(F.col("path"), F.col("content")).isin("docx", "hwpx")).select("path", "content").mapInPandas(run, schema)


def read_blocks(files: DataFrame, merged_cells: bool = False) -> DataFrame:
    """Blocks of zipped office documents, one row each; a broken file is one row with its problem.

    ``files`` is as ``read_files`` gives it. Sections follow in the order of
    their numbers. Every file is parsed in the task that reads it. A table is
    its rows with cells parted by bars, or with ``merged_cells`` an HTML table that
    keeps row and column spans; one of a single cell is a ``box``.
    """
    blocks = _parsed(files, _blocks_of, BLOCKS)
    if not merged_cells:
        return blocks
    tables = read_tables(files).select(F.col("path").alias("_path"), F.col("pos").alias("_pos"), "html")
    met = blocks.join(tables, (F.col("path") == F.col("_path")) & (F.col("pos") == F.col("_pos")), "left")
    text = F.when(F.col("kind") == "table", F.coalesce("html", "text")).otherwise(F.col("text"))
    return met.withColumn("text", text).select(*blocks.columns)


def read_cells(files: DataFrame) -> DataFrame:
    """(path, pos, row, cell, row_span, col_span, at_row, at_col, merge, text): cells of the tables, ``pos`` as in ``read_blocks``.

    Spans, addresses and merges are as written, null where they aren't.
    """
    return _parsed(files, _cells_of, CELLS)


def read_tables(files: DataFrame) -> DataFrame:
    """(path, pos, n_rows, n_cols, html): the tables of the documents with their merged cells."""
    cells, keys = read_cells(files), ["path", "pos"]
    by_run = F.max(F.col("merge").isNotNull()).over(Window.partitionBy(*keys))
    marked = cells.withColumn("_down", by_run)
    down = merge_down(marked.where("_down").drop("_down"), keys)
    placed = place_cells(marked.where("NOT _down").drop("_down"), keys, at_row="at_row", at_col="at_col")
    return table_html(placed.unionByName(down), keys)


def read_markdown(files: DataFrame) -> DataFrame:
    """Blocks of Markdown files: headings (with their level as section), table rows, paragraphs, by line."""
    text = F.regexp_replace(F.decode("content", "UTF-8"), "\r\n?", "\n")
    lines = files.where(engine_of(F.col("path"), F.col("content")) == "markdown").select("path", F.posexplode(F.split(text, "\n")).alias("pos", "x"))
    marks = F.regexp_extract("x", "^(#{1,6}) ", 1)
    kind = F.when(marks != "", "heading").when(F.col("x").rlike("^\\s*\\|"), "table").otherwise("paragraph")
    return lines.where(F.trim("x") != "").select(
        "path", "pos", F.length(marks).alias("section"), kind.alias("kind"), F.trim(F.regexp_replace("x", "^#{1,6} ", "")).alias("text"), F.lit(None).cast("string").alias("problem")
    )


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """Dictionary terms from landed API pages: JSON files that hold ``items`` with attribute values."""
    pages = spark.read.option("multiLine", "true").schema("items array<struct<values:map<string,array<string>>>>").json(path)
    return pages.select(F.explode("items").alias("i")).select(F.col("i.values").alias("values"))


def write_markdown(docs: DataFrame, folder: str, name: str = "name", text: str = "text") -> None:
    """One UTF-8 text file a row under ``folder``/name=..., for programs that read files."""
    docs.select(name, text).repartition(name).write.partitionBy(name).mode("overwrite").option("lineSep", "\n").text(folder)
