"""Operators over ordered rows: windows, selection, as-of and range lookups."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def page_fields(chunks: DataFrame, doc: str, order: str, section: str) -> DataFrame:
    """1-based page, 0-based place on the page, chunks on the page, pages of the document."""
    page = Window.partitionBy(doc, section)
    return chunks.select(
        "*",
        (F.col(section) + 1).alias("i_page"),
        (F.row_number().over(page.orderBy(order)) - 1).alias("i_chunk_on_page"),
        F.count(F.lit(1)).over(page).alias("n_chunk_of_page"),
        (F.max(section).over(Window.partitionBy(doc)) + 1).alias("n_page"),
    )


def heading_trail(blocks: DataFrame, doc: str, order: str, level: str, label: str, depth: int = 4) -> DataFrame:
    """Add ``trail``: headings in force at each block. A heading closes those of its level and deeper."""
    before = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = {k: F.max(F.when(F.col(level) == k, F.col(order))).over(before) for k in range(1, depth + 1)}
    out = blocks.withColumns({f"_at{k}": c for k, c in at.items()})
    out = out.withColumns({f"_l{k}": F.last(F.when(F.col(level) == k, F.col(label)), ignorenulls=True).over(before) for k in at})
    parts = []
    for k in at:
        shallower = [F.coalesce(F.col(f"_at{j}"), F.lit(-1)) for j in range(1, k)]
        alive = F.col(f"_at{k}").isNotNull()
        for s in shallower:
            alive &= s < F.col(f"_at{k}")
        parts.append(F.when(alive, F.col(f"_l{k}")))
    return out.withColumn("trail", F.array_compact(F.array(*parts))).drop(*[f"_at{k}" for k in at], *[f"_l{k}" for k in at])


def fill_both_ways(rows: DataFrame, key: str, order: str, value: str, out: str) -> DataFrame:
    """Nulls take the last value before them, or at the head the first after."""
    # both frames grow with the row, the second over rows in reverse; one that shrinks would be summed anew for each row
    so_far = lambda by: F.last(value, ignorenulls=True).over(Window.partitionBy(key).orderBy(by).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    down, up = so_far(order), so_far(F.desc(order))
    return rows.withColumn(out, F.coalesce(down, up))


def select_spread(rows: DataFrame, key: str, order: str, value: Column, count: int) -> DataFrame:
    """The ``count`` highest by value to 3 places; ties at the cut are taken evenly over their order."""
    w = Window.partitionBy(key)
    rows = rows.withColumn("_v", F.round(value, 3))
    rows = rows.withColumn("_rank", F.row_number().over(w.orderBy(F.desc("_v"), order)))
    rows = rows.withColumn("_cut", F.max(F.when(F.col("_rank") == F.least(F.lit(count), F.count(F.lit(1)).over(w)), F.col("_v"))).over(w))
    rows = rows.withColumn("_above", F.count_if(F.col("_v") > F.col("_cut")).over(w))
    tie = Window.partitionBy(key, "_v")
    rows = rows.withColumns({"_i": F.row_number().over(tie.orderBy(order)) - 1, "_n": F.count(F.lit(1)).over(tie)})
    need = F.least(F.lit(count) - F.col("_above"), F.col("_n"))
    picks = F.transform(F.sequence(F.lit(0), need - 1), lambda s: F.floor((2 * s + 1) * F.col("_n") / (2 * need)))
    take = (F.col("_v") > F.col("_cut")) | ((F.col("_v") == F.col("_cut")) & F.array_contains(picks, F.col("_i").cast("long")))
    return rows.where(take).drop("_v", "_rank", "_cut", "_above", "_i", "_n")


def keep_last(rows: DataFrame, key: str, item: str, order: str, n: int) -> DataFrame:
    """The last ``n`` distinct items of a key, each at its latest place: an LRU of n after all saves."""
    last = rows.groupBy(key, item).agg(F.max(order).alias(order))
    return last.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order), item))).where(F.col("place") <= n)


def next_at_or_after(left: DataFrame, right: DataFrame, key: str, at: str, value: str, out: str) -> DataFrame:
    """Forward as-of join: for each left row the earliest right ``value`` at or after it, else the latest before.

    One sort of both sides together, no inequality join: right rows stand in
    the union, and windows carry them to the left rows.
    """
    cols = left.columns
    l = left.withColumns({"_side": F.lit(0), "_v": F.lit(None).cast(dict(right.dtypes)[value])})
    r = right.select(key, F.col(at), F.col(value).alias("_v")).withColumn("_side", F.lit(1))
    both = l.unionByName(r, allowMissingColumns=True)
    # both frames end before the row and grow with it, the second over rows in reverse
    last = lambda *by: F.last("_v", ignorenulls=True).over(Window.partitionBy(key).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1))
    after, before = last(F.desc(at), F.desc("_side"), F.desc("_v")), last(at, "_side", "_v")
    return both.withColumn(out, F.coalesce(after, before)).where("_side = 0").select(*cols, out)


def first_of_equal(rows: DataFrame, key: str, same: str) -> DataFrame:
    """Each row's representative (smallest key of rows with equal ``same``) and how many there are.

    Groups are found on a hash of the value, and sums come before the shuffle.
    Null values are one group.
    """
    mark = F.coalesce(F.sha2(same, 256), F.lit(""))
    groups = rows.groupBy(mark.alias("_h")).agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("n_same"))
    return rows.select(key, mark.alias("_h")).join(groups, "_h").select(key, "first", "n_same")


def cut_lineage(rows: DataFrame) -> DataFrame:
    """``rows``, worked out and written to the checkpoint folder, so that what follows doesn't repeat it and a lost executor doesn't either.

    The folder is ``spark.checkpoint.dir``'s; a session on one machine without it takes a folder of its own.
    """
    sc = rows.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="docloom-")
        sc.setCheckpointDir(folder)
    return rows.checkpoint()


#: Rows of a table that one partition of it gets, where tasks hold a partition's sort in memory.
EACH = 100_000


def parts_for(rows: DataFrame, each: int = EACH) -> int:
    """So many partitions that each has about ``each`` rows; a table of Parquet files is counted from its footers.

    With a fixed number the partitions, and the memory of a task, would grow with the table.
    """
    return max(rows.sparkSession.sparkContext.defaultParallelism, rows.count() // each + 1)


def dealt(rows: DataFrame, keys: list[str], parts: int | None) -> DataFrame:
    """``rows`` with each key's in one of ``parts`` partitions, or of the session's number."""
    return rows.repartition(parts, *keys) if parts else rows.repartition(*keys)


def scan(rows: DataFrame, keys: list[str], order: list[str | Column], out: str, kind: str, start: Callable, step: Callable, used: list[str], parts: int | None = None) -> DataFrame:
    """``rows`` with ``out``: what ``step`` gives along each key's rows in order.

    ``step(state, *values of used)`` returns (new state, value); ``start()``
    is the state at a key's first row. For rules that no window frame can
    say. Rows are sorted and streamed, and only one state is held, so the
    size of a key doesn't matter for memory. ``parts`` is the number of partitions, if not the session's.
    """
    schema = StructType([*rows.schema.fields, *StructType.fromDDL(f"`{out}` {kind}").fields])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, None
        for frame in frames:
            values = []
            for x in zip(*[frame[c] for c in (*keys, *used)], strict=True):
                key = tuple(None if v != v else v for v in x[: len(keys)])
                if key != at:
                    at, state = key, start()
                state, value = step(state, *x[len(keys) :])
                values.append(value)
            yield frame.assign(**{out: values})

    return dealt(rows, keys, parts).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
