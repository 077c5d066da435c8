"""Pieces that several operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: space and the ASCII controls 9 to 13. ``bytes.split()`` splits on the same six.
SPACES = "[\\x20\\x09-\\x0D]+"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows and bytes of text that reach Python at once where memory is short: a batch is held by the JVM and by the worker.
SMALL = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset a session on one machine takes a folder of its own; on a
    cluster, where executors would each write to their own disk, that is an
    error.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="docloom-")
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/docloom/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts lineage: a lost executor costs at most the step under way. The
    shuffle files of the step go as soon as it ends, so the disk never holds
    the shuffles of two steps.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with settings(spark, {CLEANUP: "true"}):
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(*by) if by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


@contextlib.contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]):
    """The session with other settings within it; a Spark that doesn't know one does without it."""
    before = {}
    for name, value in wanted.items():
        with contextlib.suppress(Exception):
            before[name] = spark.conf.get(name, None)
            spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            with contextlib.suppress(Exception):
                spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def shuffles(spark: SparkSession, least: int):
    """Within it, shuffles have ``least`` partitions or the session's own number, if that is more; Spark still splits skewed ones."""
    name = "spark.sql.shuffle.partitions"
    return settings(spark, {name: str(max(int(spark.conf.get(name)), least))})


def drop(*tables: DataFrame) -> None:
    """Delete what ``materialize`` wrote, once nothing reads it any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._scratch)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def words_of(text: Column) -> Column:
    """Words of a text as an array; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def let(value: Column, body) -> Column:
    """``body`` with ``value`` bound once, so that it is not evaluated again for each use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Name of the column that operators add to a table for the time of a join.
KEY = "_docloom_key"


def row_key(row_id: Column, text: Column) -> Column:
    """An id as a long; a row without one gets a number of 2^62 or more that follows from its text."""
    by_text = F.shiftrightunsigned(F.xxhash64(text), 2).bitwiseOR(F.lit(1 << 62))
    return F.coalesce(row_id.cast("long"), by_text)


def prefix_sums(df: DataFrame, group: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over all rows of the group before this one, in ``order``.

    Rows are dealt out by range of ``group + order``, so one large group is
    split over many tasks. Each task sums within itself; one row a task and
    group carries the totals to the tasks that follow. Nulls sort first. Rows
    that tie get distinct offsets.
    """
    from pyspark.sql import Window

    keys = [F.col(c) for c in group + order]
    dealt = materialize(df.repartitionByRange(*keys).withColumn("_pid", F.spark_partition_id()), "ranged")
    rows = Window.partitionBy("_pid", *group).orderBy(*order)
    totals = dealt.groupBy("_pid", *group).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    local = F.coalesce(F.sum(value).over(rows.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    a, b = dealt.withColumn(out, local).alias("a"), totals.alias("b")
    same = F.col("a._pid") == F.col("b._pid")
    for c in group:
        same &= F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return a.join(b, same).select(
        *[F.col(f"a.{c}") for c in df.columns], (F.col(f"a.{out}") + F.col("b._base")).alias(out)
    )


#: Bytes of text that a task turns into Python objects at once; a longer text comes alone.
SLICE = 1 << 20


def slices(batch, column: int, limit: int = SLICE) -> Iterator:
    """An Arrow batch in pieces of at most ``limit`` bytes of the given text column, one row at least."""
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(ends):
        done = int(ends[at - 1]) if at else 0
        to = max(int(np.searchsorted(ends, done + limit, "right")), at + 1)
        yield batch.slice(at, to - at)
        at = to


def release() -> None:
    """Hand memory that Arrow and the C heap hold unused back to the system: Spark's Python workers outlive their tasks."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


_kept: dict = {}


def kept(name: str, make: Callable):
    """What a Python worker keeps from task to task under ``name``, made at first use. Tasks of other names clear it."""
    if name not in _kept:
        _kept[name] = make()
    return _kept[name]


def forget(but: str | None = None) -> None:
    """Give up what earlier tasks of this worker kept under other names."""
    gone = [name for name in _kept if name != but]
    for name in gone:
        del _kept[name]
    if gone:
        release()


def lean(run: Callable, keep: str | None = None) -> Callable:
    """A mapInArrow function that gives back its memory once a task is through, but for what is ``kept`` under the name ``keep``."""

    def lean_run(batches: Iterator) -> Iterator:
        forget(keep)
        yield from run(batches)
        release()

    return lean_run


def text_bytes(column) -> list[bytes]:
    """An Arrow string column as bytes; nulls are empty."""
    import pyarrow as pa

    column = column.cast(pa.string() if pa.types.is_large_string(column.type) else column.type)
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit integers that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
