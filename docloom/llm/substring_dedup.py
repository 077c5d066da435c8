"""Exact removal of repeated word windows, found through difference-cover anchors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop, lean, materialize, mix64, shuffles, slices, text_bytes

WINDOW = 13
#: A difference cover modulo 7: any two positions are both in the cover after one of 7 common shifts.
PERIOD, COVER = 7, (0, 1, 3)
#: Anchors that one bucket is meant to hold, and that a task gathers before it hands them on.
PER_BUCKET, FLUSH = 1 << 20, 1 << 20
PACKED = "bucket long, rows binary, data binary, sure binary"


def _word_hashes(text: bytes) -> np.ndarray:
    words = text.split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, count=len(words))


def _window_hashes(words: np.ndarray, size: int, factor: int) -> np.ndarray:
    """A hash of each run of ``size`` consecutive words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, power, f = np.zeros(n, np.uint64), 1, factor | 1
    for i in range(size):
        out += words[i : i + n] * np.uint64(power)
        power = power * f % (1 << 64)
    return mix64(out)


def _anchors(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the cover, and a hash of the ``window - PERIOD + 1`` words from each.

    A window at i in one text and at j in another has, at one of the shifts 0 to
    6, both i + shift and j + shift in the cover; the anchor there lies within
    the window, so equal windows share it.
    """
    hashes = _window_hashes(words, window - PERIOD + 1, 0x9E3779B97F4A7C15)
    at = np.arange(len(hashes))
    at = at[np.isin(at % PERIOD, COVER)]
    return at, hashes[at]


def _packed(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, rows, data, sure) in batches."""
    types = (pa.int64(), pa.binary(), pa.binary(), pa.binary())
    for at in range(0, len(rows), 64):
        some = rows[at : at + 64]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in some], t) for i, t in enumerate(types)], ["bucket", "rows", "data", "sure"])


def _edges(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin in sorted columns, and the end."""
    n = len(keys[0])
    if not n:
        return np.zeros(1, np.int64)
    change = np.zeros(n - 1, bool)
    for k in keys:
        change |= k[1:] != k[:-1]
    return np.r_[0, np.flatnonzero(change) + 1, n]


def _respond(row: np.ndarray, at: np.ndarray, groups: int) -> list[tuple]:
    """(row, position) answers packed by group of rows, under negative bucket numbers, so that they pass other buckets by."""
    key = (mix64(row.view(np.uint64)) % np.uint64(groups)).astype(np.int64)
    order = np.argsort(key, kind="stable")
    key, row, at = key[order], row[order], at[order].astype(np.uint32)
    edges = _edges(key)
    return [(-1 - int(key[a]), row[a:b].tobytes(), at[a:b].tobytes(), b"") for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, list, list]]:
    """Rows that come sorted by bucket, a bucket at a time."""
    now, held = None, ([], [], [])
    for b in batches:
        for k, *parts in zip(*(c.to_pylist() for c in b.columns[:4]), strict=True):
            if k != now:
                if now is not None:
                    yield now, *held
                now, held = k, ([], [], [])
            for x, part in zip(held, parts, strict=True):
                x.append(part)
    if now is not None:
        yield now, *held


def _dealt(df: DataFrame, tasks: int) -> DataFrame:
    # each task gets equally many buckets, which a hash of their numbers wouldn't give
    return df.repartitionById(tasks, F.pmod(F.col("bucket"), F.lit(tasks)).cast("int")).sortWithinPartitions("bucket")


def _exchange(texts: DataFrame, gather: Callable, flush: Callable, settle: Callable, tasks: int, groups: int) -> DataFrame:
    """(row, spots): the positions of each row that ``flush`` or ``settle`` answers.

    Each task runs ``gather`` over its texts, which gives equally long arrays
    for a text, and every ``FLUSH`` of them ``flush``, which answers what the
    task can tell by itself and sends on the rest, packed by bucket: what many
    texts hold is a few entries for each flush, however many texts hold it.
    ``settle`` answers the entries of a whole bucket. Answers are dealt by
    group of rows and brought together.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for b in slices(batch, 1):
                for args in zip(b.column(0).to_pylist(), text_bytes(b.column(1)), *(c.to_pylist() for c in b.columns[2:]), strict=True):
                    found = gather(*args)
                    if len(found[0]):
                        held.append(found)
                        n += len(found[0])
                    if n >= FLUSH:
                        yield from _packed(flush(*(np.concatenate(x) for x in zip(*held, strict=True))))
                        held, n = [], 0
        if held:
            yield from _packed(flush(*(np.concatenate(x) for x in zip(*held, strict=True))))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for bucket, rows, data, sure in _by_bucket(batches):
            if bucket < 0:  # an answer already
                yield from _packed([(bucket, r, d, b"") for r, d in zip(rows, data, strict=True)])
                continue
            found = settle(rows, data, sure)
            if len(found[0]):
                held.append(found)
                n += len(found[0])
            if n >= FLUSH:
                yield from _packed(_respond(*(np.concatenate(x) for x in zip(*held, strict=True)), groups))
                held, n = [], 0
        if held:
            yield from _packed(_respond(*(np.concatenate(x) for x in zip(*held, strict=True)), groups))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows, data, _ in _by_bucket(batches):
            row, at = np.frombuffer(b"".join(rows), np.int64), np.frombuffer(b"".join(data), np.uint32)
            order = np.lexsort((at, row))
            row, at = row[order], at[order]
            edges = _edges(row)
            spots = [np.unique(at[a:b]).tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(row[edges[:-1]]), pa.array(spots, pa.binary())], ["row", "spots"])

    answers = _dealt(texts.mapInArrow(lean(send), PACKED), tasks).mapInArrow(lean(meet), PACKED)
    return _dealt(answers, tasks).mapInArrow(lean(join), "row long, spots binary")


def shared_anchors(texts: DataFrame, window: int, buckets: int, groups: int, tasks: int) -> DataFrame:
    """(row, spots): where in each of (row, text) an anchor stands that two rows or more hold.

    Anchors are compared by 32 bits within a bucket, so that one in some
    thousand may be marked for nothing; what follows compares whole windows.
    """

    def gather(row: int, text: bytes):
        at, key = _anchors(_word_hashes(text), window)
        return key, np.full(len(at), row, np.int64), at.astype(np.uint32)

    def flush(key, row, at):
        order = np.lexsort((row, key))
        key, row, at = key[order], row[order], at[order]
        edges = _edges(key)
        many = row[edges[:-1]] != row[edges[1:] - 1]  # in two rows of this flush
        met = np.repeat(many, np.diff(edges))
        out = _respond(row[met], at[met], groups)
        sure, one = key[edges[:-1]][many], (key[~met], row[~met], at[~met])
        bucket = np.r_[one[0], sure] % np.uint64(buckets)
        low = (np.r_[one[0], sure] // np.uint64(buckets)).astype(np.uint32)
        order = np.argsort(bucket, kind="stable")  # a bucket's single entries come before its sure ones
        edges = _edges(bucket[order])
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            i = order[a:b]
            k = i[i < len(one[0])]
            out.append((int(bucket[i[0]]), one[1][k].tobytes(), low[k].tobytes() + one[2][k].tobytes(), low[i[len(k) :]].tobytes()))
        return out

    def settle(rows, data, sure):
        row = np.frombuffer(b"".join(rows), np.int64)
        pairs = [np.frombuffer(x, np.uint32).reshape(2, -1) for x in data]
        low, at = np.concatenate(pairs, axis=1)
        known = np.unique(np.frombuffer(b"".join(sure), np.uint32))
        order = np.lexsort((row, low))
        low, row, at = low[order], row[order], at[order]
        edges = _edges(low)
        if not len(low):
            return row, at
        keys = low[edges[:-1]]
        hit = (row[edges[:-1]] != row[edges[1:] - 1]) | np.isin(keys, known, assume_unique=True)
        hit = np.repeat(hit, np.diff(edges))
        return row[hit], at[hit]

    return _exchange(texts, gather, flush, settle, tasks, groups)


def extended(texts: DataFrame, window: int, buckets: int, groups: int, tasks: int) -> DataFrame:
    """(row, spots): windows whose words also start in a row of smaller id, of (row, text, doc_id, spots: shared anchors).

    From each shared anchor a match is extended to both sides, to every run of
    ``window`` words that holds the anchor: any long match shares an aligned
    anchor, so none is missed. An extension is compared by a 64-bit hash of its
    words within buckets of an independent one.
    """

    def gather(row: int, text: bytes, doc: int, spots: bytes):
        words = _word_hashes(text)
        marks = np.zeros(len(words) + 1, np.int64)
        anchors = np.frombuffer(spots, np.uint32).astype(np.int64)
        np.add.at(marks, np.maximum(anchors - PERIOD + 1, 0), 1)
        np.add.at(marks, anchors + 1, -1)
        at = np.flatnonzero(np.cumsum(marks)[: max(len(words) - window + 1, 0)])
        first, second = (_window_hashes(words, window, f)[at] for f in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
        return first % np.uint64(buckets), second, np.full(len(at), doc, np.int64), np.full(len(at), row, np.int64), at.astype(np.uint32)

    def lowest(edges, doc, row):
        """Whether each entry of a run of equal windows has a larger id than the run's first; a row without an id is odd."""
        n = np.diff(edges)
        least, odd = np.repeat(doc[edges[:-1]], n), np.repeat(row[edges[:-1]] & 1, n)
        return (doc > least) | ((doc == least) & (row & 1 > odd))

    def flush(bucket, second, doc, row, at):
        order = np.lexsort((at, row & 1, doc, second, bucket))
        bucket, second, doc, row, at = (x[order] for x in (bucket, second, doc, row, at))
        gone = lowest(_edges(bucket, second), doc, row)
        out = _respond(row[gone], at[gone], groups)
        bucket, second, doc, row, at = (x[~gone] for x in (bucket, second, doc, row, at))
        edges = _edges(bucket)
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            out.append((int(bucket[a]), row[a:b].tobytes(), second[a:b].tobytes() + doc[a:b].tobytes() + at[a:b].tobytes(), b""))
        return out

    def settle(rows, data, sure):
        sizes = [len(x) // 8 for x in rows]
        row = np.frombuffer(b"".join(rows), np.int64)
        second = np.concatenate([np.frombuffer(x, np.uint64, n) for x, n in zip(data, sizes, strict=True)])
        doc = np.concatenate([np.frombuffer(x, np.int64, n, 8 * n) for x, n in zip(data, sizes, strict=True)])
        at = np.concatenate([np.frombuffer(x, np.uint32, n, 16 * n) for x, n in zip(data, sizes, strict=True)])
        order = np.lexsort((row & 1, doc, second))
        second, doc, row, at = (x[order] for x in (second, doc, row, at))
        gone = lowest(_edges(second), doc, row)
        return row[gone], at[gone]

    return _exchange(texts, gather, flush, settle, tasks, groups)


def _cut(text: bytes, spots: bytes | None, window: int) -> tuple[int, list[bytes]]:
    """Number of words, and the words that no repeated window covers."""
    words = text.split()
    if not spots:
        return len(words), words
    starts = np.frombuffer(spots, np.uint32).astype(np.int64)
    marks = np.zeros(len(words) + 1, np.int64)
    starts = starts[starts < len(words)]
    np.add.at(marks, starts, 1)
    np.add.at(marks, np.minimum(starts + window, len(words)), -1)
    gone = np.cumsum(marks)[:-1] > 0
    return len(words), [w for w, g in zip(words, gone.tolist(), strict=True) if not g]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text): every word goes that a repeated window covers.

    A window is ``window`` (at least 7) consecutive words; it is repeated if its
    words also start in a document with a smaller id. Windows are judged on the
    input. Anchors, hashes of ``window - 6`` words, stand at cover positions
    only (3 of 7); one found in two rows is extended to the windows around it,
    which are compared as a whole. What passes between stages is packed arrays,
    dealt by hash, so no pairs of documents are formed.

    Null and empty texts have no words and an empty kept_text. Rows that repeat
    an id are separate: they don't remove one another's words, and each loses
    what smaller ids hold. A null id is larger than any, and rows without an id
    are no repeats of one another. An empty table gives an empty table. Kept
    words are joined by one space, whatever stood between. Columns of other
    names are ignored.
    """
    if window < PERIOD:
        raise ValueError(f"window must be at least {PERIOD}")
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # equal rows may share a key: they lose the same words; its last bit marks a null id
    key = F.xxhash64("doc_id", "text").bitwiseAND(F.lit(-2)).bitwiseOR(F.col("doc_id").isNull().cast("long"))
    texts = texts.withColumn("row", key)
    chars = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # about 6 bytes a word, 3 anchors for 7 words
    least = chars // (14 * PER_BUCKET) + 1
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), least)
    buckets = max(4 * tasks, least)
    found = materialize(shared_anchors(texts.select("row", "text"), window, buckets, tasks, tasks), "shared-anchors")
    joined = texts.join(found.withColumnRenamed("row", "_row"), F.col("row") == F.col("_row"), "left").select("row", "text", "doc_id", "spots")
    with shuffles(spark, tasks):
        first = materialize(joined.mapInArrow(lean(_first_cut), FIRST), "candidates")
    drop(found)
    again = first.where("spots is not null").select("row", "text", F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("order"), "spots")
    repeated = materialize(extended(again, window, buckets, tasks, tasks), "repeated-windows")
    second = first.where("spots is not null").select("row", "text", "doc_id").join(repeated.withColumnRenamed("row", "_row"), F.col("row") == F.col("_row"), "left")
    with shuffles(spark, tasks):
        second = materialize(second.select("doc_id", "text", repeated.spots).mapInArrow(lean(_last_cut(window)), LAST), "cut")
    drop(repeated)
    done = first.where("spots is null").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("text").alias("kept_text"))
    return done.unionByName(second)


FIRST = "row long, text string, doc_id long, spots binary, n_words long"
LAST = "doc_id long, n_words long, n_removed long, kept_text string"


def _first_cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as their words joined by spaces, and how many they are."""
    for batch in batches:
        for b in slices(batch, 1):
            words = [x.split() for x in text_bytes(b.column(1))]
            texts = pa.array([b" ".join(w) for w in words], pa.binary()).cast(pa.string())
            sizes = pa.array(map(len, words), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), texts, b.column(2), b.column(3), sizes], ["row", "text", "doc_id", "spots", "n_words"])


def _last_cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, 1):
                cuts = [_cut(t, s, window) for t, s in zip(text_bytes(b.column(1)), b.column(2).to_pylist(), strict=True)]
                texts = pa.array([b" ".join(k) for _, k in cuts], pa.binary()).cast(pa.string())
                n, gone = [c for c, _ in cuts], [c - len(k) for c, k in cuts]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), texts], ["doc_id", "n_words", "n_removed", "kept_text"])

    return run
