"""Tables in files: CSV in unknown encodings and workbooks, as rows with inferred types."""

from __future__ import annotations

import csv
import io
import itertools
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .documents import _tag

ROWS = "path string, sheet string, row int, cells array<string>, problem string"
#: Encodings in the order they are tried where no mark of byte order tells: the first that reads every byte.
GUESSES = ("utf-8", "cp949", "latin-1")
MARKED = ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"))
# The text of an empty cell, the name of a CSV's only sheet, and the room that a text column has beyond its longest.
NULL, ONLY_SHEET, ROOM = "null", "table_1", 10


def decoded(content: bytes) -> tuple[str, str]:
    """(text, encoding) of a file: by its mark of byte order, by zeros in every other byte, or by the first guess that fits."""
    for mark, name in MARKED:
        if content.startswith(mark):
            return content.decode(name, errors="replace"), name
    for name, zeros in (("utf-16-le", content[1::2]), ("utf-16-be", content[::2])):
        if len(content) % 2 == 0 and 2 * zeros.count(0) > len(zeros) > 0:
            return content.decode(name, errors="replace"), name
    for name in GUESSES:
        try:
            return content.decode(name), name
        except UnicodeDecodeError:
            continue
    raise ValueError("unreachable: the last guess reads every byte")


def _csv_rows(content: bytes) -> Iterator[tuple]:
    text = decoded(content)[0]
    for cells in csv.reader(io.StringIO(text, newline="")):
        if cells:
            yield ONLY_SHEET, [c if c != "" else None for c in cells]


def _column(ref: str) -> int:
    """The number of a cell's column, from 0, by its letters."""
    n = 0
    for c in re.match("[A-Z]*", ref)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def _texts(node: ElementTree.Element) -> str:
    return "".join(x.text or "" for x in node.iter() if _tag(x) == "t")


def _book_rows(content: bytes) -> Iterator[tuple]:
    """Rows of a workbook's sheets in its order: shared and inline strings, numbers and truth values as they are written."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = [_texts(x) for x in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        links = {x.get("Id"): x.get("Target") for x in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        sheets = [x for x in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if _tag(x) == "sheet"]
        for sheet in sheets:
            target = links[next(v for k, v in sheet.attrib.items() if k.endswith("}id"))]
            with z.open("xl/" + target.removeprefix("/xl/")) as part:
                for _, node in ElementTree.iterparse(part):
                    if _tag(node) != "row":
                        continue
                    cells: dict[int, str | None] = {}
                    for c in node:
                        kind, value = c.get("t"), next((x.text for x in c if _tag(x) == "v"), None)
                        if kind == "s":
                            value = shared[int(value)]
                        elif kind == "inlineStr":
                            value = _texts(c)
                        elif kind == "b":
                            value = {"1": "true", "0": "false"}.get(value)
                        cells[_column(c.get("r") or "") if c.get("r") else len(cells)] = value or None
                    node.clear()
                    if cells:
                        yield sheet.get("name"), [cells.get(i) for i in range(max(cells) + 1)]


def read_rows(files: DataFrame) -> DataFrame:
    """(path, sheet, row, cells, problem): the rows of CSV files (sheet ``table_1``) and workbooks; row 0 is the header.

    A CSV's encoding is told by its bytes. Each file is read in the task that has it, row by row. Rows may be
    short; empty cells are null, empty rows left out. A file that can't be read is one row with its problem.
    """
    names = [c.split()[0] for c in ROWS.split(", ")]

    def of(path: str, content: bytes) -> Iterator[tuple]:
        try:
            rows = _book_rows(content) if content.startswith(b"PK\x03\x04") else _csv_rows(content)
            for _, some in itertools.groupby(rows, key=lambda r: r[0]):
                for i, (sheet, cells) in enumerate(some):
                    yield path, sheet, i, cells, None
        except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, IndexError, ValueError, csv.Error) as e:
            yield path, None, -1, None, type(e).__name__

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                rows = of(path, content or b"")
                while some := list(itertools.islice(rows, 5000)):
                    yield pd.DataFrame(some, columns=names)

    return files.select("path", "content").mapInPandas(run, ROWS)


def cells_of(rows: DataFrame) -> DataFrame:
    """(path, sheet, row, col, name, value): a row for each cell below the header, named by it; a nameless column is ``Unnamed: `` and its number."""
    from ..operators.tables import _beside

    good = rows.where("problem IS NULL")
    head = good.where("row = 0").select("path", "sheet", F.col("cells").alias("_head"))
    body = _beside(good.where("row > 0"), head, ["path", "sheet"])
    width = F.greatest(F.size("_head"), F.size("cells"))
    spread = body.select("path", "sheet", "row", "cells", "_head", F.explode(F.sequence(F.lit(0), width - 1)).alias("col"))
    name = F.coalesce(F.get("_head", F.col("col")), F.concat(F.lit("Unnamed: "), F.col("col").cast("string")))
    return spread.select("path", "sheet", "row", "col", name.alias("name"), F.get("cells", F.col("col")).alias("value"))


SHAPES = {"int": "^[-+]?\\d{1,18}$", "float": "^[-+]?(\\d+\\.?\\d*|\\.\\d+)([eE][-+]?\\d+)?$", "bool": "(?i)^(true|false)$", "date": "^\\d{4}-\\d{2}-\\d{2}([ T].*)?$"}


def infer_types(cells: DataFrame) -> DataFrame:
    """(path, sheet, col, name, type, n, nulls): each column's SQL type over all of its rows, by sums before the shuffle.

    BIGINT, FLOAT, BOOLEAN or DATE if every value is one; else VARCHAR with room for 10 characters more than the longest value. A column with an empty
    cell that isn't text all the same counts only its values; one without any is VARCHAR(10 + the word for null).
    """
    value = F.col("value")
    fits = {k: F.min(F.when(value.isNotNull(), value.rlike(shape))) for k, shape in SHAPES.items()}
    longest = F.max(F.length(F.coalesce(value, F.lit(NULL))))
    kind = (
        F.when(fits["int"], "BIGINT").when(fits["float"], "FLOAT").when(fits["bool"], "BOOLEAN").when(fits["date"], "DATE")
        .otherwise(F.concat(F.lit("VARCHAR("), (longest + ROOM).cast("string"), F.lit(")")))
    )
    return cells.groupBy("path", "sheet", "col", "name").agg(kind.alias("type"), F.count(F.lit(1)).alias("n"), F.count_if(value.isNull()).alias("nulls"))


def records(cells: DataFrame) -> DataFrame:
    """(path, sheet, row, record): each row as a map of names to texts, empty cells as ``null``; of columns with one name the last counts."""
    pair = F.struct("col", F.struct("name", F.coalesce("value", F.lit(NULL)).alias("value")).alias("x"))
    pairs = F.transform(F.array_sort(F.collect_list(pair)), lambda p: p["x"])
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["name"] == p["name"]))
    return cells.groupBy("path", "sheet", "row").agg(F.map_from_entries(last).alias("record"))


def csv_line(values: list[Column]) -> Column:
    """A row as a line of CSV: values with commas, quotes or line ends in quotes, nulls empty."""
    def cell(c: Column) -> Column:
        text = F.coalesce(c.cast("string"), F.lit(""))
        return F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)

    return F.concat_ws(",", *map(cell, values))
