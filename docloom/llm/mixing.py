"""Mixing sources to target weights by drawing fixed-length blocks."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from .shared import KEY, materialize, mix64, prefix_sums, release, row_key, slices, words_of

WEIGHTS, EXPAND, REPEAT = (5, 2, 1), 1.5, 2
#: Words a block, and output shards.
BLOCK, SHARDS, SEED = 256, 64, 11
#: Slots that one row stands for before it is exploded, and slots that a task makes.
CHUNK, PER_TASK = 4096, 1 << 17
#: Sources (under 200 bytes each) up to which their table is broadcast.
BROADCAST_SOURCES = 10_000


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, expand: float = EXPAND, repeat: int = REPEAT) -> list[float]:
    """Words each source gives: shares of ``expand`` times all words by weight, none over ``repeat`` times its size."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    left, out, free = expand * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while free:
        unit = left / sum(w[i] for i in free)
        over = {i for i in free if unit * w[i] > repeat * sizes[i]}
        for i in over or free:
            out[i] = float(repeat * sizes[i]) if over else unit * w[i]
        if not over:
            break
        left -= sum(out[i] for i in over)
        free -= over
    return out


def shard_counts(quotas: list[int], shards: int, seed: int = SEED) -> np.ndarray:
    """Slots of each source in each shard: multinomial draws from what is left, so that the sums are the quotas."""
    rng = np.random.default_rng(seed)
    left = np.array(quotas, np.int64)
    out = np.zeros((shards, len(quotas)), np.int64)
    for k in range(shards):
        n = int(left.sum()) // (shards - k)
        if n:
            drawn = left.copy() if k == shards - 1 else np.minimum(rng.multinomial(n, left / left.sum()), left)
            spare = n - int(drawn.sum())
            for i in np.argsort(drawn - left, kind="stable"):  # what the cap refused goes where most is left
                more = min(spare, int(left[i] - drawn[i]))
                drawn[i] += more
                spare -= more
            out[k] = drawn
            left -= drawn
    return out


def permute(at: np.ndarray, size: np.ndarray, key: np.ndarray, back: bool = False) -> np.ndarray:
    """Place ``at`` of a pseudorandom permutation of 0 .. size-1, one for each key: Feistel rounds, walked into range.

    ``back`` gives the place at which ``at`` stands.
    """
    x, n, k = at.astype(np.uint64), size.astype(np.uint64), mix64(key.astype(np.int64).view(np.uint64))
    bits = np.maximum(np.ceil(np.log2(np.maximum(n.astype(np.float64), 2)) / 2), 1).astype(np.uint64)
    mask = (np.uint64(1) << bits) - np.uint64(1)
    todo = np.ones(len(x), bool)
    while todo.any():
        left, right = x[todo] >> bits[todo], x[todo] & mask[todo]
        for r in range(4):
            if back:
                left, right = right ^ (mix64(left + k[todo] + np.uint64(0x9E37 * (4 - r))) & mask[todo]), left
            else:
                left, right = right, left ^ (mix64(right + k[todo] + np.uint64(0x9E37 * (r + 1))) & mask[todo])
        x[todo] = (left << bits[todo]) | right
        todo[todo] = x[todo] >= n[todo]
    return x.astype(np.int64)


@F.pandas_udf(LongType())
def permuted(at: pd.Series, size: pd.Series, key: pd.Series) -> pd.Series:
    return pd.Series(permute(at.to_numpy(), size.to_numpy(), key.to_numpy()))


def plan_source(i: int, size: int, goal: float, block: int, repeat: int, seed: int) -> dict:
    """How a source of ``size`` words gives ``goal`` of them: whole turns through its blocks, then ``rest`` words of one more.

    ``short`` is what the last block lacks; ``place`` where it comes in the
    last turn, so that slots know the words before them.
    """
    turns, rest = divmod(min(round(goal), repeat * size), max(size, 1))
    n_blocks = -(-size // block)
    short = n_blocks * block - size
    keys = mix64(np.arange(repeat + 1, dtype=np.uint64) + np.uint64(i * (repeat + 1)) + mix64(np.array([seed], np.uint64))).view(np.int64)
    place = int(permute(np.array([n_blocks - 1]), np.array([n_blocks]), keys[turns : turns + 1], back=True)[0]) if rest else 0
    more = -(-rest // block)
    if more and place < more and more * block - short < rest:
        more += 1
    return {"s": i, "source_size": size, "target": goal, "n_blocks": n_blocks, "turns": turns, "rest": rest, "short": short,
            "place": place, "slots": turns * n_blocks + more, "keys": keys.tolist()}


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    expand: float = EXPAND,
    repeat: int = REPEAT,
    block: int = BLOCK,
    shards: int = SHARDS,
    seed: int = SEED,
) -> DataFrame:
    """(doc_id, source, size, start, source_size, target, pieces): which words of each document the mix takes.

    A source's texts, in id order, are one string of words cut into blocks of
    ``block`` words (the last may be shorter). Its target in words is so many
    whole turns through its blocks and a part of one more, which its slots give
    to the word. Each output shard draws its count of each source's slots from
    a multinomial over what is left; a slot is a place of a pseudorandom
    permutation of the blocks, a new one each turn, so no block is taken more
    than ``repeat`` times. Slots and documents' parts meet in a join on
    (source, block). ``pieces`` are (shard, slot, from, to): word ranges in the
    document.

    The driver holds one row a source and ``shards`` counts for each (some 2 KB
    a source: it takes some hundred thousand), never a document. Slots are made
    by as many tasks as there are ``PER_TASK`` of them. Sources are weighed in
    code-point order, null last. Null and blank texts have size 0 and no
    pieces; a null id is an id. Rows that repeat an id are separate; of rows
    with the same source, id and size either may come first. An empty table
    gives an empty table. The same rows give the same mix.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.size(words_of(F.col(text_col).cast("string"))).cast("long").alias("size"),
    )
    rows = prefix_sums(rows, ["source"], ["doc_id", "size"], "size", "start")
    rows = materialize(rows, "offsets")
    sums = rows.groupBy("source").agg(F.sum("size").alias("n")).collect()
    sums.sort(key=lambda r: (r.source is None, r.source or ""))
    goal = targets([r.n for r in sums], weights, expand, repeat)
    plans = [{"source": r.source} | plan_source(i, r.n, goal[i], block, repeat, seed) for i, r in enumerate(sums)]
    sources = spark.createDataFrame(
        plans,
        "s int, source string, source_size long, target double, n_blocks long, turns long, rest long, short long, place long, slots long, keys array<long>",
    )
    hint = F.broadcast if len(plans) <= BROADCAST_SOURCES else lambda df: df
    quotas = [p["slots"] for p in plans]
    counts, firsts = shard_counts(quotas, shards, seed), np.zeros(len(quotas), np.int64)
    draws = []
    for k in range(shards):
        draws += [(i, k, int(firsts[i]), int(n)) for i, n in enumerate(counts[k]) if n]
        firsts += counts[k]
    draws = spark.createDataFrame(draws, "s int, shard int, first long, n long")
    chunks = draws.select("s", "shard", "first", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / CHUNK))).alias("c"))
    chunks = chunks.repartition(sum(quotas) // PER_TASK + 1, "s", "shard", "c")
    lo = F.col("first") + F.col("c") * CHUNK
    hi = F.least(lo + CHUNK, F.col("first") + F.col("n")) - 1
    slots = chunks.select("s", "shard", F.explode(F.sequence(lo, hi)).alias("slot"))
    slots = slots.join(hint(sources.select("s", "n_blocks", "turns", "rest", "short", "place", "keys")), "s")
    slots = slots.withColumns({"turn": F.floor(F.col("slot") / F.col("n_blocks")), "at": F.col("slot") % F.col("n_blocks")})
    before = F.col("at") * block - F.when(F.col("place") < F.col("at"), F.col("short")).otherwise(0)
    slots = slots.select(
        "s", "shard", "slot",
        permuted("at", "n_blocks", F.get("keys", F.col("turn").cast("int"))).alias("block"),
        F.when(F.col("turn") < F.col("turns"), F.lit(block)).otherwise(F.least(F.lit(block), F.col("rest") - before)).alias("take"),
    )
    named = rows.join(hint(sources.select(F.col("source").alias("_source"), "s", "source_size", "target")), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    parts = named.where("size > 0").select("doc_id", "s", "start", "size", F.explode(F.sequence(first, last)).alias("block"))
    met = parts.join(slots, ["s", "block"])
    begin = F.col("block") * block
    a = F.greatest(begin, "start") - F.col("start")
    b = F.least(begin + F.col("take"), F.col("start") + F.col("size")) - F.col("start")
    met = met.select("doc_id", "s", "start", F.struct("shard", "slot", a.alias("from"), b.alias("to")).alias("p")).where("p.from < p.to")
    pieces = met.groupBy("doc_id", "s", "start").agg(F.sort_array(F.collect_list("p")).alias("pieces"))
    p, n = pieces.alias("p"), named.alias("n")
    same = F.col("n.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("n.s") == F.col("p.s")) & (F.col("n.start") == F.col("p.start")) & (F.col("n.size") > 0)
    return n.join(p, same, "left").select("n.doc_id", "n.source", "n.size", "n.start", "n.source_size", "n.target", "p.pieces")


def mix_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", chars_col: str = "n_chars") -> DataFrame:
    """``docs`` as the mix takes them: one row a document, its text the taken word ranges, repeats included.

    Documents of which nothing is taken go; neighbouring ranges stay one text;
    other ranges follow each other on a line of their own. A row's length
    column, if it has one, is set to the new length. Rows without an id are
    told apart by their texts. Of rows that repeat an id, each that the mix
    takes words of gives a row, with the text of one row of that id, source and
    number of words.
    """
    own = [F.col(c) for c in docs.columns]
    keyed = docs.select(
        *own, row_key(docs[id_col], docs[text_col]).alias(KEY),
        F.size(words_of(docs[text_col].cast("string"))).cast("long").alias(f"{KEY}_size"), docs[source_col].cast("string").alias(f"{KEY}_source"),
    )
    taken = mix(keyed, KEY, text_col, source_col).where(F.size("pieces") > 0)
    taken = taken.select(*[F.col(c).alias(f"{KEY}_{c}_taken") for c in ("doc_id", "source", "size", "start", "pieces")])
    # beside the id, differences and not equalities: the rows stay dealt by id alone
    same = (F.col(f"{KEY}_size") - F.col(f"{KEY}_size_taken") == 0) & ~(F.coalesce(f"{KEY}_source", F.lit("")) != F.coalesce(f"{KEY}_source_taken", F.lit("")))
    joined = keyed.join(taken, (keyed[KEY] == F.col(f"{KEY}_doc_id_taken")) & same)
    joined = joined.dropDuplicates([KEY, f"{KEY}_source_taken", f"{KEY}_start_taken"])
    ranges = F.sort_array(F.transform(f"{KEY}_pieces_taken", lambda x: F.struct(x["from"].alias("from"), x["to"].alias("to"), x["slot"].alias("slot"))))
    joined = joined.withColumn(text_col, _cut(F.col(text_col).cast("string"), ranges))
    if chars_col in docs.columns:
        joined = joined.withColumn(chars_col, F.length(text_col).cast("long"))
    return joined.select(*own)


@F.arrow_udf(StringType())
def _cut(texts: pa.Array, ranges: pa.Array) -> pa.Array:
    """The given word ranges of each text; ranges of the first round, in order, then those of later rounds."""
    out: list[str] = []
    for b in slices(pa.RecordBatch.from_arrays([texts, ranges], ["text", "ranges"]), 0):
        out += map(_cut_one, b.column(0).to_pylist(), b.column(1).to_pylist())
    release()
    return pa.array(out, pa.string())


def _cut_one(text: str, spans: list[dict]) -> str:
    places = np.fromiter((x for m in re.finditer("[^\\x20\\x09-\\x0D]+", text) for x in m.span()), np.int64).reshape(-1, 2)
    rounds: list[list[list[int]]] = []
    for s in spans:
        at = next((r for r in rounds if r[-1][1] <= s["from"]), None)
        if at is None:
            rounds.append([[s["from"], s["to"]]])
        elif at[-1][1] == s["from"]:
            at[-1][1] = s["to"]
        else:
            at.append([s["from"], s["to"]])
    return "\n".join(text[places[a, 0] : places[b - 1, 1]] for r in rounds for a, b in r)
