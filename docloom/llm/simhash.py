"""SimHash near-duplicates with covering locality-sensitive hashing."""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import KEY, drop, lean, materialize, row_key, slices, text_bytes

BITS, RADIUS, SEED = 64, 3, 42
#: A bucket of up to so many fingerprints is compared as a whole; a larger one is split by further masks.
BUCKET = 512
#: Name of the column that holds a text's hash while rows are chosen.
HASH = "_docloom_hash"
LEVELS = 4


@lru_cache
def covering_masks(level: int, radius: int = RADIUS, bits: int = BITS) -> tuple[int, ...]:
    """2^(radius+1) - 1 masks such that any ``radius`` bit positions lie outside one of them.

    Each position gets a non-zero vector of radius+1 bits; mask v holds the
    positions whose vector has odd inner product with v. Any ``radius`` vectors
    leave some v orthogonal to them all, so two fingerprints within the radius
    are equal under that mask (covering LSH, Pagh 2016). ``level`` deals the
    vectors out differently.
    """
    top = 1 << (radius + 1)
    vectors = [1 + i % (top - 1) for i in range(bits)]
    random.Random(1000 + level).shuffle(vectors)
    masks = []
    for v in range(1, top):
        m = sum(1 << i for i, x in enumerate(vectors) if bin(x & v).count("1") % 2)
        masks.append(m - (1 << bits) if m >= 1 << (bits - 1) else m)
    return tuple(masks)


def fingerprint(text: bytes, ngram: int = 3) -> int:
    """The 64-bit SimHash of a text: words lower-cased in A-Z, shingles of ``ngram`` words, repeats counted.

    A bit is set if it is set in over half the shingle hashes (XXH64, seed 42).
    """
    words = text.lower().split()
    if not words:
        return 0
    n = len(words) - ngram + 1
    ones = np.zeros(BITS, np.int64)
    if n <= 1:
        n, shingles = 1, iter([b" ".join(words)])
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(ngram)), strict=False))
    left = n
    hashes = map(xxhash.xxh64_intdigest, shingles, repeat(SEED))
    while left:  # in pieces, so that a very long text needs no more memory
        h = np.fromiter(hashes, np.uint64, count=min(left, 1 << 16))
        left -= len(h)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = 3, more: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, more, fp): one row a row of ``docs``, fp the SimHash as a signed long. Null and blank texts give 0.

    ``more`` are long columns to keep.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, batch.num_columns - 1):
                fps = np.array([fingerprint(x, ngram) for x in text_bytes(b.columns[-1])], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fps)], ["doc_id", *more, "fp"])

    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), *more, F.col(text_col).cast("string").alias("text"))
    return kept.mapInArrow(lean(run), ", ".join(f"{c} long" for c in ("doc_id", *more, "fp")))


def _components_of(fps: np.ndarray) -> np.ndarray:
    """For the fingerprints of one bucket, the position of the first member each can reach."""
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= RADIUS
    label = np.arange(len(fps))
    while True:
        low = np.where(near, label[None, :], len(fps)).min(axis=1)
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _link_buckets(last: bool):
    """Over rows sorted by (mask, bucket): edges of small buckets; large buckets' rows pass on, as heavy."""
    names = ["a", "b", "mask", "fp", "rep"]

    def out(a, b, mask, fp, rep) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, mask, fp, rep)], names)

    def settle(rows: np.ndarray, whole: bool) -> Iterator[pa.RecordBatch]:
        """rows (4, n) of mask, bucket, fp, rep. whole: the last bucket ends here."""
        starts = np.flatnonzero(np.r_[True, (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])])
        ends = np.r_[starts[1:], rows.shape[1]]
        many = ends - starts > 1
        a, b = [], []
        for s, e in zip(starts[many], ends[many], strict=True):
            if e - s <= BUCKET or last:
                reps = rows[3, s:e]
                order = np.argsort(reps, kind="stable")
                label = _components_of(rows[2, s:e][order].view(np.uint64))
                moved = np.flatnonzero(label != np.arange(e - s))
                a.append(reps[order][moved])
                b.append(reps[order][label[moved]])
        if a:
            a, b = np.concatenate(a), np.concatenate(b)
            yield out(a, b, *[np.zeros(len(a), np.int64)] * 3)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((4, 0), np.int64)
        heavy = None  # the (mask, bucket) that was found too large and is passed on as it comes
        for batch in batches:
            rows = np.stack([np.asarray(batch.column(i)) for i in range(4)])
            held = np.concatenate([held, rows], axis=1)
            if heavy is not None:
                same = (held[0] == heavy[0]) & (held[1] == heavy[1])
                n = held.shape[1] if same.all() else int(np.argmin(same))
                if n:
                    x = held[:, :n]
                    yield out(np.full(n, None), np.full(n, None), x[0], x[2], x[3])
                held = held[:, n:]
                if not held.shape[1]:
                    continue
                heavy = None
            changes = np.flatnonzero((held[0, 1:] != held[0, :-1]) | (held[1, 1:] != held[1, :-1])) + 1
            cut = int(changes[-1]) if len(changes) else 0
            if cut:
                yield from pick(held[:, :cut])
                held = held[:, cut:]
            if held.shape[1] > BUCKET and not last:
                heavy = (held[0, 0], held[1, 0])
                n = held.shape[1]
                yield out(np.full(n, None), np.full(n, None), held[0], held[2], held[3])
                held = held[:, :0]
        if held.shape[1]:
            yield from pick(held)

    def pick(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        yield from settle(rows, True)
        if not last:
            starts = np.flatnonzero(np.r_[True, (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])])
            sizes = np.diff(np.r_[starts, rows.shape[1]])
            big = np.repeat(sizes > BUCKET, sizes)
            if big.any():
                x = rows[:, big]
                n = x.shape[1]
                yield out(np.full(n, None), np.full(n, None), x[0], x[2], x[3])

    return run


def _linked(prints: DataFrame) -> DataFrame:
    """(node, component): fingerprints that chain within 3 bits with others, and the smallest of their chain.

    Fifteen masks put each node in fifteen buckets; every pair within three
    bits meets in one of them. A bucket of over ``BUCKET`` nodes is passed on
    row by row, never held, and split by a further covering family on top of
    its mask, until at the last level so few free bits remain that a bucket is
    small by construction. Within a bucket only the links of a spanning forest
    are kept.
    """
    rows = prints.select("fp").distinct().select(F.lit(0).cast("long").alias("mask"), "fp", F.col("fp").alias("rep"))
    found, spent = None, []
    for level in range(LEVELS):
        masks = F.array(*[F.lit(m).cast("long") for m in covering_masks(level)])
        dealt = rows.select(F.explode(masks).alias("more"), "mask", "fp", "rep").select(
            F.col("mask").bitwiseOR(F.col("more")).alias("mask"), "fp", "rep"
        )
        if level:
            dealt = dealt.distinct()
        dealt = dealt.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("bucket"), "fp", "rep")
        dealt = dealt.repartition("mask", "bucket").sortWithinPartitions("mask", "bucket", "rep")
        step = materialize(
            dealt.mapInArrow(lean(_link_buckets(level == LEVELS - 1)), "a long, b long, mask long, fp long, rep long"), "links"
        )
        spent.append(step)
        links = step.where("a is not null").select("a", "b")
        found = links if found is None else found.unionByName(links)
        rows = step.where("a is null").select("mask", "fp", "rep")
        if rows.isEmpty():
            break
    groups = connected_components(found)
    drop(*spent)
    return groups


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs``: texts whose fingerprints chain within 3 bits.

    Each fingerprint is one node from the start (a copy group of any size is
    one row); a component has the name of its smallest doc_id. Null or blank
    texts have fingerprint 0 and are linked like any other; rows with the same
    doc_id stay separate rows, and join no components. A row without doc_id is
    linked like any other; component_id is null only if its whole component
    has none. An empty table gives an empty table.
    """
    prints = materialize(fingerprints(docs, id_col, text_col, ngram), "fingerprints")
    groups = _linked(prints)
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    met = nodes.join(groups, nodes.fp == groups.node).select("fp", "rep", "component")
    names = met.groupBy("component").agg(F.min("rep").alias("name"))
    named = met.join(names, "component").select(F.col("fp").alias("_node"), F.col("name"), F.lit(True).alias("_met"))
    classes = nodes.join(named, nodes.fp == F.col("_node"), "left").select(
        F.col("fp").alias("_fp"), F.when(F.col("_met"), F.col("name")).otherwise(F.col("rep")).alias("component_id")
    )
    return prints.join(classes, prints.fp == F.col("_fp")).select("doc_id", "fp", "component_id")


def hex_fingerprint(fp):
    """A signed long as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the one of smallest id. Columns stay as they are.

    Of rows of a group that share that id the one of smallest text hash stays;
    rows of one id in different groups are chosen apart. A row without an id
    stays if no row with one is in its group, and of several such rows one does.
    """
    text = F.col(text_col).cast("string")
    keyed = docs.withColumns({KEY: row_key(docs[id_col], docs[text_col]), HASH: F.xxhash64(text)})
    prints = materialize(fingerprints(keyed, KEY, text_col, more=(HASH,)), "fingerprints")
    groups = _linked(prints)
    rows = prints.join(groups, prints.fp == groups.node, "left").groupBy(F.coalesce("component", "fp").alias("_group"))
    keep = rows.agg(F.min(F.struct(F.col("doc_id").alias(KEY), HASH)).alias("k")).select("k.*")
    return keyed.join(keep, [KEY, HASH], "left_semi").dropDuplicates([KEY, HASH]).select(*docs.columns)
