"""Packing under a budget in streams: wide table rows cut cell by cell, rows to parts that say how many they are, neighbours merged while their headings agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import scan
from .tables import _beside

# Cells up to so many characters are repeated in every piece of their row; how a part's title is written.
ANCHOR = 40
PART = (" (표 ", "/", ")")
#: A number of parts has at most so many digits.
DIGITS = 7


def _segments(text: Column, room: Column) -> Column:
    """A text in segments of at most ``room`` characters, that end with their line or sentence where one ends; joined they are the text."""
    found = F.regexp_extract_all(text, F.lit("(?s).+?(?:\n|[.!?]\\s+|\\z)"), F.lit(0))
    slices = lambda s: F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length(s) / room).cast("int") - 1, F.lit(0))), lambda i: F.substring(s, i * room + 1, room))
    return F.flatten(F.transform(found, slices))


def _fill(state: tuple, size: int, room: int) -> tuple:
    """The piece a segment goes to: the one at hand, or a new one where it has no room left."""
    piece, used = state
    if used and used + size > room:
        piece, used = piece + 1, 0
    return (piece, used + size), piece


def split_wide_rows(cells: DataFrame, keys: list[str], limit: int, row: str = "row", cell: str = "cell", text: str = "text", anchor: int = ANCHOR) -> DataFrame:
    """(keys, row, piece, cell, text, anchor): rows of more than ``limit`` characters in pieces; other rows are one piece.

    Short cells are anchors: every piece has them whole, so that it can be read
    alone. Long cells are cut at ends of lines and sentences, else hard, and
    fill the pieces one after the other; nothing is lost and nothing stands twice. A
    piece holds at most ``limit`` characters, or one segment of a quarter of it where the anchors leave less room. Segments are streamed
    by row, so a row of any length needs one number.

    Null texts are empty; rows of anchors alone are one piece, however long. Cells that tie go by their text, null keys are a table.
    """
    own = [*keys, row]
    rows = cells.select(*own, F.col(cell).alias("cell"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    short = F.length("text") <= anchor
    sums = rows.groupBy(*own).agg(F.sum(F.length("text")).alias("_all"), F.sum(F.when(short, F.length("text")).otherwise(0)).alias("_anchors"), F.count_if(~short).alias("_long"))
    rows = _beside(rows.withColumn("anchor", short), sums, own)
    room = F.greatest(F.lit(limit) - F.col("_anchors"), F.lit(max(limit // 4, 1))).cast("int")
    rows = rows.withColumn("_room", F.when((F.col("_all") <= limit) | (F.col("_long") == 0), F.greatest(F.col("_all"), F.lit(1)).cast("int")).otherwise(room))
    spread = rows.where("NOT anchor").select(*own, "cell", "_room", F.posexplode(_segments(F.col("text"), F.col("_room"))).alias("seg", "text"))
    packed = scan(spread.withColumn("_n", F.length("text")), own, ["cell", "seg"], "piece", "int", lambda: (0, 0), _fill, ["_n", "_room"])
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg", "text"))), lambda s: s["text"]), "")
    long = packed.groupBy(*own, "piece", "cell").agg(joined.alias("text")).withColumn("anchor", F.lit(False))
    last = packed.groupBy(*own).agg(F.max("piece").alias("_last"))
    repeated = _beside(rows.where("anchor").select(*own, "cell", "text"), last, own)
    repeated = repeated.select(*own, F.explode(F.sequence(F.lit(0), F.coalesce("_last", F.lit(0)))).alias("piece"), "cell", "text", F.lit(True).alias("anchor"))
    return long.select(*own, "piece", "cell", "text", "anchor").unionByName(repeated)


def _pack(state: tuple, size: int, rooms) -> tuple:
    """For each number of digits the part that a row goes to, if parts have so much room."""
    out = []
    for (part, used), room in zip(state, rooms, strict=True):
        if used and used + size > room:
            part, used = part + 1, 0
        out.append((part, used + size))
    return tuple(out), [part for part, _ in out]


def table_parts(rows: DataFrame, keys: list[str], order: list[str], limit: int, size: str = "size", head: str | None = None, title: str | None = None) -> DataFrame:
    """``rows`` with ``part`` (from 1), ``parts`` and ``prefix``: consecutive rows of a table up to ``limit`` characters, each part under its title and head.

    Room is kept for the head row (``head``: its characters) and for a prefix
    of the title and ``(표 i/n)``, whose length depends on how many parts there
    are, which depends on the room. So each row is packed at once for
    every number of digits, in one pass, and the smallest that the count of parts fits
    stands. A table of one part has its title alone as prefix.

    A row beyond the budget is a part of its own; nulls count as empty, null keys are a table.
    """
    of = lambda c, n: F.lit(0) if c is None else F.coalesce(n(F.col(c)), F.lit(0))
    reserve = of(head, lambda c: c.cast("int")) + of(title, F.length)
    rooms = F.array(*[F.greatest(F.lit(limit) - reserve - sum(map(len, PART)) - 2 * d, F.lit(1)) for d in range(1, DIGITS + 1)])
    packed = scan(rows.withColumns({"_size": F.coalesce(F.col(size).cast("int"), F.lit(0)), "_rooms": rooms}), keys, order, "_parts", "array<int>", lambda: ((0, 0),) * DIGITS, _pack, ["_size", "_rooms"])
    top = packed.groupBy(*keys).agg(F.array(*[F.max(F.get("_parts", F.lit(d))) + 1 for d in range(DIGITS)]).alias("_top"))
    fits = F.filter(F.sequence(F.lit(0), F.lit(DIGITS - 1)), lambda d: F.get("_top", d) < F.pow(F.lit(10.0), d + 1))
    met = _beside(packed, top.withColumn("_d", F.coalesce(F.get(fits, F.lit(0)), F.lit(DIGITS - 1))), keys)
    part, parts = F.get("_parts", F.col("_d")) + 1, F.get("_top", F.col("_d"))
    name = F.lit("") if title is None else F.coalesce(F.col(title), F.lit(""))
    numbered = F.concat(name, F.lit(PART[0]), part.cast("string"), F.lit(PART[1]), parts.cast("string"), F.lit(PART[2]))
    return met.select(*rows.columns, part.alias("part"), parts.alias("parts"), F.when(parts > 1, numbered).otherwise(name).alias("prefix"))


def _join(state: tuple, path, size: int, limit: int) -> tuple:
    """The group of a chunk: that of the one before it, if their headings agree and both have room in one."""
    group, at, used = state
    mine = None if path is None else tuple(path)
    if group < 0 or mine != at or used + 1 + size > limit:
        return (group + 1, mine, size), group + 1
    return (group, at, used + 1 + size), group


def merge_chunks(chunks: DataFrame, key: str, order: str, path: str = "path", text: str = "text", limit: int = 1000) -> DataFrame:
    """(key, i, path, n, text): neighbouring chunks under the same headings as one, while they have room in ``limit`` characters.

    Texts are joined by line ends. A chunk over the limit stays alone. A key's
    chunks are streamed and only the size of the group at hand is held; a group's texts, which the limit bounds,
    then come together. Null texts are empty, null paths are headings like any other, null keys are one; ties in ``order`` go by the text.
    """
    rows = chunks.select(F.col(key), F.col(order).alias("_o"), F.col(path).alias("path"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumns({"_n": F.length("text"), "_limit": F.lit(limit)})
    grouped = scan(rows, [key], ["_o", "text"], "i", "int", lambda: (-1, None, 0), _join, ["path", "_n", "_limit"])
    texts = F.transform(F.array_sort(F.collect_list(F.struct("_o", "text"))), lambda x: x["text"])
    return grouped.groupBy(key, "i", "path").agg(F.count(F.lit(1)).alias("n"), F.array_join(texts, "\n").alias("text"))


def whole_rows(pieces: DataFrame, keys: list[str], row: str = "row") -> DataFrame:
    """(keys, row, cell, text): rows put together again from their pieces."""
    w = Window.partitionBy(*keys, row, "cell").orderBy("piece")
    first = pieces.withColumn("_i", F.row_number().over(w)).where("NOT anchor OR _i = 1")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("piece", "text"))), lambda x: x["text"])
    return first.groupBy(*keys, row, "cell").agg(F.array_join(texts, "").alias("text"))
