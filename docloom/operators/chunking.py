"""Texts to pieces under a budget. Each text is cut in the task that holds it; nothing is shuffled but for ``rebuild``."""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import scan

HEADING = re.compile(r"\s*#+[ \t]")
FENCE = re.compile(r"\s*(```|~~~)")


def pieces(texts: DataFrame, key: str, text: str, cut: Callable[[str], list], schema: str = "piece string") -> DataFrame:
    """(key, i, ...): what ``cut`` makes of each text, numbered from 0. Null texts give no rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in schema.split(", ")]
        for frame in frames:
            every = ((k, i, *(x if isinstance(x, tuple) else (x,))) for k, t in zip(frame["k"], frame["t"], strict=True) for i, x in enumerate(cut(t)))
            while some := list(itertools.islice(every, 5000)):
                yield pd.DataFrame(some, columns=["k", "i", *names])

    kind = dict(texts.dtypes)[key]
    rows = texts.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"))
    return rows.mapInPandas(run, f"k {kind}, i int, {schema}").withColumnRenamed("k", key)


def line_chunks(text: str, budget: int) -> list[str]:
    """Whole lines up to ``budget`` characters; past 60% of it a heading starts anew; a longer line is cut hard."""
    out, held, size = [], [], 0
    for line in [*text.split("\n"), None]:
        long = line is not None and len(line) > budget
        full = line is not None and (size + len(line) + 1 > budget or (size >= 0.6 * budget and HEADING.match(line)))
        if held and (line is None or long or full):
            out.append("\n".join(held).strip())
            held, size = [], 0
        if long:
            out += [line[i : i + budget] for i in range(0, len(line), budget)]
        elif line is not None:
            held.append(line)
            size += len(line) + 1
    return [x for x in out if x.strip()]


def split_lines(texts: DataFrame, key: str, text: str, budget: int = 12000) -> DataFrame:
    return pieces(texts, key, text, lambda t: line_chunks(t, budget))


def _blocks(text: str) -> list[str]:
    """Lines kept whole with their ends; fences, HTML tables and pipe tables are one block each."""
    out, until = [], None
    for line in text.splitlines(keepends=True):
        bar = line.lstrip().startswith("|")
        joined = out and (until or (bar and out[-1].splitlines()[-1].lstrip().startswith("|")))
        if joined:
            out[-1] += line
        else:
            out.append(line)
        if until:
            until = None if until in line.lower() else until
        elif m := FENCE.match(line):
            until = m[1]
        elif "<table" in line.lower() and "</table" not in line.lower():
            until = "</table"
    return out


def lossless_chunks(text: str, budget: int) -> list[tuple[str, str]]:
    """(piece, suffix) whose joined pieces and suffixes are the text; a suffix is the blank space at a piece's end.

    Blocks that can't be cut (fences, tables) may be longer than ``budget``.
    """
    out, held = [], ""
    for block in _blocks(text):
        if held and len(held) + len(block) > budget:
            out.append(held)
            held = ""
        held += block
    return [(x.rstrip(), x[len(x.rstrip()) :]) for x in [*out, held] if x]


def split_lossless(texts: DataFrame, key: str, text: str, budget: int = 6000) -> DataFrame:
    return pieces(texts, key, text, lambda t: lossless_chunks(t, budget), "piece string, suffix string")


def rebuild(chunks: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """(key, text): ``chunks`` joined in order, each with its result of ``results`` (key, i, result) where there is one."""
    rows = chunks.join(results.select(key, "i", "result"), [key, "i"], "left")
    part = F.concat(F.coalesce("result", "piece"), F.coalesce("suffix", F.lit("")))
    rows = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("i", part.alias("x")))).alias("a"))
    return rows.select(key, F.array_join(F.transform("a", lambda r: r["x"]), "").alias("text"))


def _sentences(text: str) -> list[str]:
    return [s for s in re.split(r"(?<=[.!?])\s+|(?<=[다요]\.)|\n", text) if s and s.strip()]


def long_text(text: str, limit: int, overlap: int) -> list[str]:
    """Sentences packed up to ``limit``; a longer sentence goes in slices that share ``overlap`` characters."""
    out, held = [], ""
    for s in _sentences(text):
        if held and len(held) + 1 + len(s) > limit:
            out.append(held)
            held = ""
        if len(s) > limit:
            out += [s[i : i + limit] for i in range(0, max(len(s) - overlap, 1), max(limit - overlap, 1))]
        else:
            held = f"{held} {s}".strip()
    return [*out, held] if held else out


def tail(text: str, size: int) -> str:
    """The last ``size`` characters, from the first sentence that starts in them; all of them if no sentence does."""
    if len(text) <= size:
        return text
    cut = re.search(r"[.!?]\s+|[다요]\.\s*|\n", text[-size:])
    return text[-size:][cut.end() if cut else 0 :]


def _chunk(limit: int, overlap: int, least: int) -> Callable:
    """A step over a document's blocks in order: chunks that are done with this block, as (section, kind, text).

    The state is the last chunk, which a very short one after it may still
    join, the text that the next one has so far, and its section.
    """

    def step(state: tuple, end: bool, section: str | None, kind: str | None, text: str | None) -> tuple:
        last, held, at = state
        done = []

        def give(chunk: tuple) -> None:
            nonlocal last
            if last:
                done.append(last)
            last = chunk

        def flush() -> None:
            nonlocal last, held
            if held.strip():
                if last and last[:2] == (at, "paragraph") and len(held) < least and len(last[2]) + 1 + len(held) <= limit:
                    last = (at, "paragraph", f"{last[2]}\n{held}")
                else:
                    give((at, "paragraph", held))
            held = ""

        if end or section != at or kind == "table":
            flush()
            at = section
        if end:
            return (None, "", None), [*done, last] if last else done
        if kind == "table":
            give((section, "table", text))
            return (last, held, at), done
        for part in long_text(text or "", limit, overlap):
            if held and len(held) + 1 + len(part) > limit:
                carried = tail(held, overlap)
                flush()
                held = carried if len(carried) + 1 + len(part) <= limit else ""
            held = f"{held}\n{part}" if held else part
        return (last, held, at), done

    return step


def chunk_blocks(blocks: DataFrame, key: str, order: str, limit: int = 1000, overlap: int = 100, least: int = 40) -> DataFrame:
    """(key, i, section, kind, text) of ``blocks`` (key, order, section, kind, text).

    A table is a chunk of its own. A new section starts a new chunk. A chunk
    begins with the end of the one before it in the section, and one shorter
    than ``least`` joins the one before. A document's blocks are streamed in order, so a
    document of any length needs two chunks in memory. Null texts are empty, null keys are a document; ties in
    ``order`` go by the text.
    """
    kinds = dict(blocks.dtypes)
    rows = blocks.select(F.col(key).alias("k"), F.col(order).alias("o"), F.col("section").cast("string").alias("s"), "kind", "text", F.lit(False).alias("end"))
    ends = rows.select("k").distinct().select("k", F.lit(None).cast(kinds[order]).alias("o"), *[F.lit(None).cast("string").alias(c) for c in ("s", "kind", "text")], F.lit(True).alias("end"))
    out = scan(rows.unionByName(ends), ["k"], ["end", "o", "text"], "done", "array<struct<section:string,kind:string,text:string>>", lambda: (None, "", None), _chunk(limit, overlap, least), ["end", "s", "kind", "text"])
    chunks = out.select("k", "end", "o", F.col("text").alias("_t"), F.posexplode("done").alias("p", "c"))
    number = F.row_number().over(Window.partitionBy("k").orderBy("end", "o", "_t", "p")) - 1
    return chunks.select(F.col("k").alias(key), number.alias("i"), F.col("c.section").cast(kinds["section"]).alias("section"), "c.kind", "c.text")


def pack_batches(units: DataFrame, key: str, order: str, text: str, chars: int = 4000, items: int = 10) -> DataFrame:
    """``units`` (key, order) with ``batch``: consecutive units up to ``chars`` characters and ``items`` units."""

    def step(state: tuple, length: int) -> tuple:
        batch, size, n = state
        if n and (size + length > chars or n >= items):
            batch, size, n = batch + 1, 0, 0
        return (batch, size + length, n + 1), batch

    rows = units.select(key, order, F.coalesce(F.length(text), F.lit(0)).alias("_n"))
    return scan(rows, [key], [order], "batch", "int", lambda: (0, 0, 0), step, ["_n"]).drop("_n")


def table_rows(html: str, limit: int) -> list[str]:
    """A table's rows in parts up to ``limit`` characters, each under the head row; a longer row stays whole."""
    rows = re.findall(r"<tr\b.*?</tr>", html, re.S | re.I)
    if len(html) <= limit or len(rows) < 2:
        return [html]
    out, held = [], ""
    for row in rows[1:]:
        if held and len(rows[0]) + len(held) + len(row) + 15 > limit:
            out.append(held)
            held = ""
        held += row
    return [f"<table>{rows[0]}{x}</table>" for x in [*out, held]]


def split_tables(tables: DataFrame, key: str, html: str, limit: int = 1000) -> DataFrame:
    return pieces(tables, key, html, lambda t: table_rows(t, limit))
