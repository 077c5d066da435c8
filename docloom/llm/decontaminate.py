"""Benchmark items inside long documents: size-partitioned MinHash containment, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import KEY, let, materialize, row_key, words_of

NGRAM, CONTAINED = 5, 0.8
#: Min-hashes a item. One that is contained at 0.8 misses them all with probability 0.2^16, under 1e-11.
SKETCH = 16
#: Rows up to which a table of ids and hashes (under 32 bytes a row) is broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 500_000


def _shingles(words, make):
    """``make(words, first)`` per shingle of five words; a shorter text has one, all its words; an empty one null."""

    def of(w):
        n = F.size(w)
        some = F.transform(F.sequence(F.lit(0), F.greatest(n - NGRAM, F.lit(0))), lambda i: make(w, i))
        return F.when(n > 0, some)

    # bound once: an array of words that is inlined would be split anew for each shingle
    return let(words, of)


def _hashes(words):
    # null past the end leaves the hash as it was, so a short text hashes all its words
    return _shingles(words, lambda w, i: F.xxhash64(*[F.get(w, i + k) for k in range(NGRAM)]))


def _strings(words):
    return F.array_distinct(_shingles(words, lambda w, i: F.array_join(F.slice(w, i + 1, NGRAM), " ")))


def _small(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast if it is counted to be small; else as it is."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    threshold: float = CONTAINED,
) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared): items of whose 5-word shingles a document holds at least 0.8.

    Items fall into classes by shingle count (powers of two). An item is
    represented by its min-hash shingles, 16 independent minima, all its
    shingles if it has fewer; a document is a candidate if it holds one of them
    and is large enough for the item's class. That is containment, not
    resemblance, so the document's length doesn't dilute it. Candidates are
    then verified on the shingles themselves.

    Words are lower-cased and split at blanks. Texts without words hold and
    match nothing; one of fewer than five words is a single shingle. Rows that
    repeat an id and text repeat no pair; null ids are kept out of pairs. Empty
    tables give an empty table.
    """
    corpus = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    corpus = corpus.withColumn("words", words_of(F.lower("text"))).where(F.size("words") > 0)
    tests = items.select(F.col(item_col).cast("long").alias("item_id"), words_of(F.lower(F.col(item_text_col).cast("string"))).alias("words"))
    tests = materialize(
        tests.where((F.size("words") > 0) & F.col("item_id").isNotNull())
        .select("item_id", _strings(F.col("words")).alias("shingles"), F.array_distinct(_hashes(F.col("words"))).alias("hashes"))
        .dropDuplicates(["item_id", "shingles"])
        .withColumn("class", F.floor(F.log2(F.size("shingles"))).cast("int")),
        "items",
    )
    # the least size of a document that can hold an item of the class
    floor_size = F.ceil(threshold * F.pow(F.lit(2.0), "class")).cast("int")
    hashed = tests.select("item_id", floor_size.alias("least"), F.explode("hashes").alias("h"))
    minima = hashed.select("item_id", "least", "h", F.explode(F.sequence(F.lit(0), F.lit(SKETCH - 1))).alias("j"))
    sketch = minima.groupBy("item_id", "least", "j").agg(F.min_by("h", F.xxhash64("h", "j")).alias("h"))
    sketch = materialize(sketch.select("item_id", "least", "h").distinct(), "sketch")
    shingled = corpus.select("doc_id", _hashes(F.col("words")).alias("hashes"))
    shingled = shingled.select("doc_id", F.size("hashes").alias("n"), F.explode_outer("hashes").alias("dh"))
    small = _small(sketch)
    hits = shingled.join(small, (F.col("dh") == F.col("h")) & (F.col("n") >= F.col("least")))
    pairs = materialize(hits.select("doc_id", "item_id").distinct(), "pairs")
    wanted = _small(pairs.select(F.col("doc_id").alias("d"), "item_id"))
    found = corpus.join(wanted, F.col("doc_id") == F.col("d")).select("doc_id", "item_id", _strings(F.col("words")).alias("own"))
    found = found.join(tests.select(F.col("item_id").alias("i"), "shingles"), F.col("item_id") == F.col("i"))
    found = found.select(
        "doc_id", "item_id",
        F.size("shingles").alias("n_shingles"),
        F.size(F.array_intersect("own", "shingles")).alias("n_shared"),
    )
    # whole numbers, so that 4 of 5 is exactly 0.8
    enough = 1000 * F.col("n_shared") >= round(1000 * threshold) * F.col("n_shingles")
    best = F.max(F.struct("n_shared", "n_shingles")).alias("best")
    return found.where(enough).groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.n_shingles", "best.n_shared")


def remove_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without those that hold an item, columns as they were. Rows without an id are told apart by their texts."""
    keyed = docs.withColumn(KEY, row_key(docs[id_col], docs[text_col]))
    found = contained_items(keyed, items, KEY, text_col).select(F.col("doc_id").alias(KEY)).distinct()
    return keyed.join(found, KEY, "left_anti").select(*docs.columns)
