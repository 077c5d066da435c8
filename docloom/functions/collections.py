"""Values, blocks and JSON of sessions and answers, as Column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let


def merge_values(state: Column, accepted: Column, clears: Column) -> Column:
    """``state`` with ``accepted`` put over it and the names of ``clears`` taken out."""
    kept = F.map_filter(state, lambda k, v: ~F.array_contains(F.map_keys(accepted), k))
    return F.map_filter(F.map_concat(kept, accepted), lambda k, v: ~F.array_contains(clears, k))


def cleared(state: Column, accepted: Column, clears: Column) -> Column:
    """Names of ``clears`` that had a value, in their order."""
    held = F.concat(F.map_keys(state), F.map_keys(accepted))
    return F.filter(clears, lambda c: F.array_contains(held, c))


def merge_blocks(blocks: Column, added: Column, clears: Column, most: int = 200) -> Column:
    """Struct (blocks, overflow): places of ``clears`` go first, then ``added`` comes at the end up to ``most`` in all."""
    left = F.filter(blocks, lambda b, i: ~F.array_contains(clears, i))
    room = F.greatest(F.lit(most) - F.size(left), F.lit(0))
    return F.struct(F.concat(left, F.slice(added, F.lit(1), room)).alias("blocks"), F.greatest(F.size(added) - room, F.lit(0)).alias("overflow"))


def append_new(items: Column, item: Column, most: int) -> Column:
    """The last ``most`` distinct items after ``item`` came last; an item that is there keeps its place."""
    every = F.array_distinct(F.concat(items, F.array(item)))
    return F.slice(every, F.greatest(F.size(every) - most, F.lit(0)) + 1, F.lit(most))


def json_object(raw: Column, schema: str) -> Column:
    """The object between the outermost braces of an answer; null if it isn't JSON."""
    return F.from_json(F.nullif(F.regexp_extract(raw, "(?s)\\{.*\\}", 0), F.lit("")), schema)


def json_array(raw: Column, item: str) -> Column:
    """The array between the outermost brackets of an answer; null if it isn't JSON."""
    return F.from_json(F.nullif(F.regexp_extract(raw, "(?s)\\[.*\\]", 0), F.lit("")), f"array<{item}>")


def entry_texts(value: Column) -> Column:
    """Parts of a text between semicolons: trimmed, distinct, none empty."""
    return F.array_distinct(F.filter(F.transform(F.split(value, ";"), lambda x: F.trim(x)), lambda x: x != ""))


def dig(raw: Column, path: str) -> Column:
    """The value at a dotted path of a JSON text; null if there is none."""
    return F.get_json_object(raw, f"$.{path}")


def upgrade(version: Column, hashes: Column, old_hash: Column, most: int = 20) -> Column:
    """Document hashes of a stored session: versions before 2 have one hash, later ones a list; distinct, the last kept."""
    every = F.when(F.coalesce(version, F.lit(1)) < 2, F.array_compact(F.array(old_hash))).otherwise(F.coalesce(hashes, F.array().cast("array<string>")))
    every = F.array_distinct(every)
    return F.slice(every, F.greatest(F.size(every) - most, F.lit(0)) + 1, F.lit(most))


#: Items that one fold of ``prefix`` goes through: it copies what it has so far at each.
RUN = 256


def prefix(values: Column, zero: Column, both: Callable[[Column, Column], Column]) -> Column:
    """For each item of an array what ``both`` makes of ``zero`` and all items before it, as of sums or greatest values.

    A fold that builds an array copies it at each step, so an array is folded
    in runs, and then over what the runs come to. ``both`` must not depend on how items are grouped.
    """

    def fold(some: Column, start: Column) -> Column:
        first = F.struct(start.alias("x"), F.slice(F.array(start), 1, 0).alias("out"))
        step = lambda acc, v: F.struct(both(acc["x"], v).alias("x"), F.concat(acc["out"], F.array(acc["x"])).alias("out"))
        return F.aggregate(some, first, step, lambda acc: acc["out"])

    def whole(given: Column) -> Column:
        firsts = F.sequence(F.lit(1), F.greatest(F.size(given), F.lit(1)), F.lit(RUN))
        return let(F.transform(firsts, lambda i: F.slice(given, i, RUN)), of_runs)

    def of_runs(runs: Column) -> Column:
        totals = F.transform(runs, lambda r: F.aggregate(r, zero, both))
        return F.flatten(F.zip_with(runs, fold(totals, zero), lambda r, start: fold(r, start)))

    return let(values, whole)
