"""Masked pseudo-likelihood of documents under a small bidirectional window network."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop, lean, materialize, slices

#: Ids are pairs of digits of DIGIT each: frequent words first, then BUCKETS ids that rarer words share by hash.
#: A rarer word then has its own part of its bucket, so no two words share a probability but by their counts.
#: The hash is Spark's ``xxhash64``, so that both sides of the join agree on a word's bucket.
DIGIT, BUCKETS, HASH_SEED = 32, 256, 42
VOCAB = DIGIT * DIGIT
EDGE = VOCAB
OFFSETS = (-2, -1, 1, 2)
WIDTH, RATE, SEED, ROUNDS = 24, 0.15, 3, 2
#: Running words in a training step, and in a step of scoring.
STEP, BATCH = 2048, 2048
#: Bytes of text whose words a task tells apart at once, words it then hashes at once, and parameters that one row carries.
GROUP, HASHED, CHUNK = 1 << 24, 1 << 16, 4096
#: Words beyond the vocabulary whose parts are broadcast (under 50 bytes each); the others meet theirs in a join.
FREQUENT = 1 << 18
#: Tasks' parameters are averaged in so many lanes first.
LANES = 64
#: A row's part of a word's log-probability is summed as a whole number of these, so that sums don't depend on their order.
UNIT = 1e-9


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) over all texts of (doc_id, text), words lower-cased in A-Z; tasks sum before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, 1, GROUP):
                met = Words.of(b.column(1))
                n = np.bincount(met.codes, minlength=len(met.distinct))
                yield pa.RecordBatch.from_arrays([met.distinct.filter(pa.array(n > 0)), pa.array(n[n > 0])], ["word", "n"])

    return docs.mapInArrow(lean(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Words(NamedTuple):
    """Running words of texts: the distinct ones, each running word's place among them, and how many each text has."""

    distinct: pa.Array
    codes: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array) -> Words:
        """Words lower-cased in A-Z, split at the six spaces of ASCII; null texts have none."""
        split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
        coded = split.flatten().dictionary_encode()
        codes = coded.indices.to_numpy()
        real = codes != pc.index(coded.dictionary, "").as_py()  # what stands before a space at the start, or after one at the end
        ends = np.r_[0, np.cumsum(real)][np.r_[0, np.cumsum(split.value_lengths().to_numpy())]]
        return cls(coded.dictionary, codes[real], np.diff(ends))


def _places(words: pa.Array, among: pa.Array) -> np.ndarray:
    """Each word's place among others, or -1."""
    return pc.fill_null(pc.index_in(words, value_set=among), -1).to_numpy()


def _ids(distinct: pa.Array, vocabulary: pa.Array) -> np.ndarray:
    """What the network knows words by: the vocabulary's by their place, others share ids by hash."""
    ids = _places(distinct, vocabulary).astype(np.int32)
    others = np.flatnonzero(ids < 0)
    for at in range(0, len(others), HASHED):
        some = others[at : at + HASHED]
        hashes = (xxhash.xxh64_intdigest(w, HASH_SEED) % BUCKETS for w in distinct.take(pa.array(some)).cast(pa.binary()).to_pylist())
        ids[some] = VOCAB - BUCKETS + np.fromiter(hashes, np.int32, count=len(some))
    return ids


SHAPES = {
    "words": (len(OFFSETS), VOCAB + 1, WIDTH), "bias": (WIDTH,), "high": (WIDTH, DIGIT), "high_bias": (DIGIT,),
    "digit": (DIGIT, WIDTH), "low": (WIDTH, DIGIT), "low_bias": (DIGIT,),
}


class Network:
    """Predicts a word from the two before and the two after it.

    The neighbours' vectors (a table for each place) add up to a hidden layer;
    it gives the first digit of the word's id, and with that digit the second.
    The two softmaxes multiply to a distribution over all ids.
    """

    def __init__(self, flat: np.ndarray | None = None):
        rng = np.random.default_rng(SEED)
        self.p, at = {}, 0
        for name, shape in SHAPES.items():
            size = int(np.prod(shape))
            start = np.zeros(shape) if "bias" in name else rng.normal(0, 0.1, shape)
            self.p[name] = (start if flat is None else flat[at : at + size].reshape(shape)).astype(np.float32)
            at += size
        self.seen = {k: np.full(v.shape, 1e-2, np.float32) for k, v in self.p.items()}

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in SHAPES])

    def forward(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """The log-probability of each target between its neighbours."""
        return self._predict(self._hidden(context.T), target)

    def train(self, context: np.ndarray, target: np.ndarray) -> None:
        """One Adagrad step on a batch."""
        n = len(target)
        ids, at = context.T.ravel(), np.arange(n)
        # a neighbour in place k gets the gradient of its word in that place's vectors only
        self._learn(self._hidden(context.T), target, n, ids, [np.r_[np.full(k * n, n), at, np.full((len(OFFSETS) - 1 - k) * n, n)] for k in range(len(OFFSETS))])

    def along(self, ids: np.ndarray) -> np.ndarray:
        """Log-probabilities of the words of running text but its two first and last; those of EDGE are left out."""
        target = ids[2:-2]
        real = target != EDGE
        return self._predict(self._between(ids), np.where(real, target, 0))[real]

    def train_along(self, ids: np.ndarray) -> int:
        """One Adagrad step on running text; its two first and last words are neighbours only. Returns the words learned."""
        target = ids[2:-2]
        real = target != EDGE
        n = int(real.sum())
        if n:
            at = np.arange(len(ids))
            owners = [np.where((at >= 2 + o) & (at < 2 + o + len(target)), at - 2 - o, len(target)) for o in OFFSETS]
            self._learn(self._between(ids), np.where(real, target, 0), n, ids, owners, real)
        return n

    def _between(self, ids: np.ndarray) -> np.ndarray:
        """Hidden layer of each word of running text but the two first and last."""
        n = len(ids) - 4
        return self._hidden([ids[2 + o : 2 + o + n] for o in OFFSETS])

    def _hidden(self, near) -> np.ndarray:
        """Hidden layer of words whose neighbours in each place are given."""
        h = self.p["words"][0].take(near[0], axis=0)
        for table, ids in zip(self.p["words"][1:], near[1:], strict=True):
            h += table.take(ids, axis=0)
        h += self.p["bias"]
        return np.tanh(h, out=h)

    def _powers(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the softmaxes of both digits raise e to, side by side, and the weights of both; the first digit adds to the second's."""
        p = self.p
        weights = np.hstack([p["high"], p["low"]])
        x = h @ weights
        x += np.r_[p["high_bias"], p["low_bias"]]
        x[:, DIGIT:] += (p["digit"] @ p["low"]).take(first, axis=0)
        return np.clip(x, -60, 60, out=x), weights  # far beyond what weights of this size give; keeps the powers finite and above zero

    def _predict(self, h: np.ndarray, target: np.ndarray) -> np.ndarray:
        first, second = np.divmod(target, DIGIT)
        x, _ = self._powers(h, first)
        picked = np.add(*(x.take(at) for at in _picked(first, second)))
        total = np.exp(x, out=x).reshape(-1, DIGIT) @ _ONES
        return picked - np.log(total).reshape(-1, 2).sum(1)

    def _learn(self, h: np.ndarray, target: np.ndarray, n: int, ids: np.ndarray, owners: list, real: np.ndarray | None = None) -> None:
        """One Adagrad step; rows that aren't ``real`` count for nothing.

        ``ids`` are the neighbours, and ``owners`` says for each place whose
        neighbour there each of them is, ``len(target)`` for nobody's.
        """
        p, (first, second) = self.p, np.divmod(target, DIGIT)
        x, weights = self._powers(h, first)
        x = np.exp(x, out=x).reshape(-1, DIGIT)
        x /= (x @ _ONES)[:, None]
        x = x.reshape(len(target), -1)
        for at in _picked(first, second):
            x.reshape(-1)[at] -= 1
        if real is not None:
            x[~real] = 0
        part = np.float32(1 / n)
        inner = np.zeros((len(target) + 1, WIDTH), np.float32)
        np.multiply(x @ (weights.T * part), 1 - h * h, out=inner[:-1])
        both, biases = h.T @ x * part, np.ones(len(x), np.float32) @ x * part
        digits, by_digit = _sums(first, [np.ascontiguousarray(x[:, DIGIT:])])
        low = np.zeros((DIGIT, DIGIT), np.float32)
        low[digits] = by_digit[0] * part
        grads = {
            "high": both[:, :DIGIT], "high_bias": biases[:DIGIT], "low": both[:, DIGIT:] + p["digit"].T @ low, "low_bias": biases[DIGIT:],
            "bias": np.ones(len(inner), np.float32) @ inner, "digit": low @ p["low"].T,
        }
        met, sums = _sums(ids, [inner] * len(OFFSETS), owners)
        for k, g in grads.items():
            p[k] -= _step(g, self.seen[k], slice(None))
        for table, seen, g in zip(p["words"], self.seen["words"], sums, strict=True):
            table[met] -= _step(g, seen, met)  # the others have no gradient


_ONES = np.ones(DIGIT, np.float32)


def _picked(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each row's first and second digit stand in a table that has both digits' values side by side."""
    rows = np.arange(0, 2 * DIGIT * len(first), 2 * DIGIT)
    return rows + first, rows + DIGIT + second


def _step(g: np.ndarray, seen: np.ndarray, rows) -> np.ndarray:
    """Adagrad's step for a gradient of some rows; their squares are added to ``seen``."""
    root = g * g
    root += seen[rows]
    seen[rows] = root
    np.sqrt(root, out=root)
    return np.float32(RATE) * g / root


def _sums(index: np.ndarray, values: list[np.ndarray], owners: list | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
    """The distinct indices, and for each array the sums of its rows by index, or of the rows that ``owners`` names."""
    order = np.argsort(index.astype(np.uint16), kind="stable")  # 16 bits sort by radix
    ordered = index[order]
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    out = []
    for k, v in enumerate(values):
        rows = v.take(order if owners is None else owners[k][order], axis=0)
        out.append(np.add.reduceat(rows.view(np.complex64), starts, axis=0).view(np.float32))  # two columns at once
    return ordered[starts], out


def _running(ids: np.ndarray, sizes: np.ndarray, step: int) -> Iterator[np.ndarray]:
    """Texts one after the other, two EDGE around each, in pieces of ``step`` words with two more on both sides."""
    every = np.full(len(ids) + 2 * len(sizes) + 2, EDGE, np.int32)
    every[np.arange(len(ids)) + np.repeat(np.arange(2, 2 * len(sizes) + 2, 2), sizes)] = ids
    for at in range(0, len(every) - 4, step):
        yield every[at : at + step + 4]


def _train_round(network, words):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, vocabulary, seen = Network(network.value), pa.array(words.value, pa.string()), 0
        for batch in batches:
            for b in slices(batch, 1, GROUP):
                met = Words.of(b.column(1))
                seen += step(net, _ids(met.distinct, vocabulary).take(met.codes), met.sizes)
        if seen:
            flat, lane = net.flat(), TaskContext.get().partitionId() % LANES
            for k in range(0, len(flat), CHUNK):
                row = [pa.array([lane], pa.int32()), pa.array([k // CHUNK], pa.int32()), pa.array([flat[k : k + CHUNK].tobytes()], pa.binary()), pa.array([float(seen)])]
                yield pa.RecordBatch.from_arrays(row, PARTS)

    def step(net: Network, ids: np.ndarray, sizes: np.ndarray) -> int:
        return sum(net.train_along(x) for x in _running(ids, sizes, STEP))

    return run


PARTS = ["lane", "k", "part", "weight"]
PARTS_DDL = "lane int, k int, part binary, weight double"


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weighted means of the parts of each lane and chunk, with the sums of their weights."""
    sums: dict[tuple, list] = {}
    for b in batches:
        for lane, k, part, w in zip(*(c.to_pylist() for c in b.columns), strict=True):
            x = sums.setdefault((lane, k), [0.0, 0.0])
            x[0] = x[0] + w * np.frombuffer(part, np.float32).astype(np.float64)
            x[1] += w
    for (lane, k), (total, w) in sums.items():
        row = [pa.array([lane], pa.int32()), pa.array([k], pa.int32()), pa.array([(total / w).astype(np.float32).tobytes()], pa.binary()), pa.array([w])]
        yield pa.RecordBatch.from_arrays(row, PARTS)


class Model(NamedTuple):
    """Vocabulary, network parameters, parts of frequent words beyond the vocabulary, the table of the other words' parts, and the part of a word met once by bucket."""

    words: list[str]
    flat: np.ndarray
    frequent: pa.Table
    shares: DataFrame
    once: list[float]


def train(docs: DataFrame, counts: DataFrame) -> Model:
    """The model of all texts of (doc_id, text).

    ``counts`` holds the words of the whole corpus. Documents are dealt by hash
    into ``ROUNDS`` parts; in each round every task runs through its share of
    one part from the same start, and the results are averaged, weighted by
    words, in lanes and then over the lanes, so every word is trained on once.
    How rows are dealt to tasks therefore shows in the parameters. The driver
    holds the vocabulary, one set of parameters (about 100,000 numbers) and
    the parts of ``FREQUENT`` words, whatever the corpus; the other words' parts
    stay a table, which grows with the corpus's distinct words.
    """
    spark = docs.sparkSession
    top = counts.orderBy(F.desc("n"), "word").limit(VOCAB - BUCKETS).collect()
    words = [r.word for r in top]
    shared = spark.sparkContext.broadcast(words)
    flat = Network().flat()
    for r in range(ROUNDS):
        part = docs.where(F.pmod(F.xxhash64("text"), F.lit(ROUNDS)) == r)
        sent = part.mapInArrow(lean(_train_round(spark.sparkContext.broadcast(flat), shared)), PARTS_DDL)
        lanes = sent.repartition("lane", "k").sortWithinPartitions("lane", "k", "weight", "part").mapInArrow(_average, PARTS_DDL)
        lanes = lanes.select(F.lit(0).alias("lane"), "k", "part", "weight")
        rows = lanes.repartition("k").sortWithinPartitions("k", "weight", "part").mapInArrow(_average, PARTS_DDL).collect()
        if rows:
            flat = np.concatenate([np.frombuffer(x.part, np.float32) for x in sorted(rows, key=lambda x: x.k)])
    return Model(words, flat, *_shares(counts, top))


def _shares(counts: DataFrame, top: list) -> tuple[pa.Table, DataFrame, list[float]]:
    """The log of a word's part of its bucket's running words, for words after ``top``: at most FREQUENT of them, and a table of the rest.

    A word that the corpus holds once follows from its bucket's sum alone, so
    the table, which is sorted for the join, does without those words.

    Words are frequent from a level on (a quarter of a power of two of their
    count) that leaves no more than FREQUENT.
    """
    least, last = (top[-1].n, top[-1].word) if top else (0, "")
    rare = counts.where((F.col("n") < least) | ((F.col("n") == least) & (F.col("word") > last)))
    rare = rare.withColumns({"bucket": F.pmod(F.xxhash64("word"), F.lit(BUCKETS)), "level": F.floor(4 * F.log2("n")).cast("int")})
    sums = {r.bucket: r.all for r in rare.groupBy("bucket").agg(F.sum("n").alias("all")).collect()}  # BUCKETS rows
    every = F.array(*[F.lit(sums.get(k, 1)).cast("long") for k in range(BUCKETS)])
    shares = rare.select("word", F.log(F.col("n") / F.get(every, F.col("bucket").cast("int"))).alias("share"), "level", "n")
    level, total = 1 << 30, 0
    for r in sorted(rare.groupBy("level").agg(F.count(F.lit(1)).alias("words")).collect(), reverse=True):
        total += r.words
        if total > FREQUENT:
            break
        level = r.level
    frequent = shares.where(F.col("level") >= level).select("word", "share").toArrow()
    once = [float(-np.log(sums.get(k, 1))) for k in range(BUCKETS)]
    return frequent, shares.where((F.col("level") < level) & (F.col("n") > 1)).select("word", "share"), once


def _score(network, words, frequent):
    """Each row's words, the sum over them of the log-probabilities, and the counts of words whose part is still to come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, vocabulary, key = Network(network.value), pa.array(words.value, pa.string()), TaskContext.get().partitionId() << 40
        common = frequent.value.column("word").cast(pa.string()).combine_chunks()
        shares = np.r_[frequent.value.column("share").to_numpy(), np.nan]  # not a number where it is still to come
        for batch in batches:
            for b in slices(batch, 1, GROUP):
                met = Words.of(b.column(1))
                yield score(net, met, _ids(met.distinct, vocabulary), shares[_places(met.distinct, common)], b, key)
                key += b.num_rows

    def score(net: Network, met: Words, ids: np.ndarray, parts: np.ndarray, b: pa.RecordBatch, key: int) -> pa.RecordBatch:
        sizes, n_texts = met.sizes, len(met.sizes)
        ends, owner = np.cumsum(sizes), np.repeat(np.arange(n_texts), sizes)
        parts = np.where(ids < VOCAB - BUCKETS, 0.0, parts)
        part = parts[met.codes]
        open_ = np.isnan(part)
        known = np.bincount(owner[~open_], weights=part[~open_], minlength=n_texts)
        # each text's words whose part is still to come, once, with how often they stand in it
        pairs, often = np.unique(owner[open_] * len(parts) + met.codes[open_], return_counts=True)
        owner, other = np.divmod(pairs, max(len(parts), 1))
        rare = met.distinct.take(pa.array(other))
        at = pa.array(np.r_[0, np.cumsum(np.bincount(owner, minlength=n_texts))], pa.int32())
        logs = [net.along(x) for x in _running(ids.take(met.codes), sizes, BATCH)]
        totals = np.r_[0.0, np.cumsum(np.concatenate([*logs, np.zeros(0)]), dtype=np.float64)]
        sums = totals[ends] - totals[ends - sizes] + known
        return pa.RecordBatch.from_arrays(
            [
                pa.array(range(key, key + n_texts), pa.int64()), b.column(0), pa.array(sizes), pa.array(sums),
                pa.ListArray.from_arrays(at, rare), pa.ListArray.from_arrays(at, pa.array(often.astype(np.int64))),
            ],
            ["key", "doc_id", "n_words", "known", "rare", "often"],
        )

    return run


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, log_likelihood, mean_log_likelihood): one row a row of ``docs``, under a model of all of them.

    Each word's log-probability given both its sides, summed over the whole
    text. A word of the network's vocabulary (the 768 most frequent) has the
    network's probability; any other has its bucket's, times its own part of
    the bucket's running words in the corpus, so that the probabilities of all
    words of the corpus add up to 1. As a neighbour a word beyond the
    vocabulary stands for its bucket. Null and empty texts have no words, sum 0
    and a null mean. Rows that repeat an id or a text are scored each, and
    weigh in training each. A text of any length is scored whole. Columns of
    other names are ignored. An empty table gives an empty table.
    """
    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    counts = materialize(count_words(kept), "words")
    out = score(kept, train(kept, counts))
    drop(counts)
    return out


def score(kept: DataFrame, model: Model) -> DataFrame:
    """The scores of (doc_id, text) under a model.

    Parts of words beyond the frequent ones come from a table of all words by a
    join. Such a word is at most one in ``FREQUENT`` of all running words or
    tied with others in its level, so that no key of the join is hot.
    """
    spark = kept.sparkSession
    run = _score(*map(spark.sparkContext.broadcast, (model.flat, model.words, model.frequent)))
    scored = materialize(kept.mapInArrow(lean(run), "key long, doc_id long, n_words long, known double, rare array<string>, often array<long>"), "scored")
    pairs = scored.select("key", F.inline(F.arrays_zip(F.col("rare").alias("word"), F.col("often").alias("n"))))
    once = F.get(F.array(*map(F.lit, model.once)), F.pmod(F.xxhash64("word"), F.lit(BUCKETS)).cast("int"))
    part = F.round(F.col("n") * F.coalesce("share", once) / UNIT).cast("long")
    parts = pairs.join(model.shares, "word", "left").groupBy("key").agg(F.sum(part).alias("part"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("doc_id", "long"), ("n_words", "long"), ("known", "double"))]
    both = scored.select("key", "doc_id", "n_words", "known", F.lit(None).cast("long").alias("part")).unionByName(parts.select("key", *none, "part"))
    sums = both.groupBy("key").agg(*[F.max(c).alias(c) for c in ("doc_id", "n_words", "known", "part")])
    total = F.col("known") + F.coalesce(F.col("part"), F.lit(0)) * UNIT
    out = materialize(sums.select("doc_id", "n_words", total.alias("log_likelihood"), F.nullif("n_words", F.lit(0)).alias("_n")), "likelihood")
    drop(scored)
    return out.select("doc_id", "n_words", "log_likelihood", (F.col("log_likelihood") / F.col("_n")).alias("mean_log_likelihood"))
