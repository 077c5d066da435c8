"""Document rules and lines that recur across a host's documents, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import let, materialize, words_of

#: A line found in more documents of one host than this is boilerplate there.
MAX_DOCS = 20
#: A document that keeps less than this share of its words, in percent, is depleted.
MIN_KEPT = 30
MIN_WORDS, MAX_REPEAT = 50, 50
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"


def _repeat_words(words):
    """Words in 3-word windows that the text holds twice or more.

    Window hashes sort with their positions; equal neighbours are repeats. The
    positions of repeats, sorted again, each cover up to three words.
    """

    def covered(ordered):
        left = F.concat(F.array(F.lit(None)), F.slice(ordered, 1, F.size(ordered) - 1))
        right = F.concat(F.slice(ordered, 2, F.size(ordered) - 1), F.array(F.lit(None)))
        trio = F.zip_with(F.arrays_zip(ordered.alias("x"), left.alias("l")), right, lambda a, r: F.struct(
            a["x"]["i"].alias("i"),
            (F.coalesce(a["x"]["h"] == a["l"]["h"], F.lit(False)) | F.coalesce(a["x"]["h"] == r["h"], F.lit(False))).alias("hit"),
        ))
        at = F.sort_array(F.transform(F.filter(trio, lambda x: x["hit"]), lambda x: x["i"]))

        def gaps(p):
            nxt = F.concat(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), F.array(F.lit(None).cast("int")))
            steps = F.zip_with(p, nxt, lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
            total = F.aggregate(steps, F.lit(0).cast("long"), lambda acc, x: acc + x)
            return F.when(F.size(p) == 0, F.lit(0).cast("long")).otherwise(total)

        return let(at, gaps)

    def count(w):
        windows = F.transform(
            F.sequence(F.lit(0), F.size(w) - 3),
            lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")),
        )
        return F.when(F.size(w) < 3, F.lit(0).cast("long")).otherwise(let(F.sort_array(windows), covered))

    return let(words, count)


def _line_key(line):
    """A line as it is compared: lower case, blanks of any kind as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(line), "[\\x20\\x09-\\x0D]+", " "))


def score_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    max_docs: int = MAX_DOCS,
    min_kept: int = MIN_KEPT,
) -> DataFrame:
    """One row a document: its counts, base_failed, n_boilerplate_words and kept.

    The lines of a document are normalised and hashed; a line that more than
    ``max_docs`` distinct documents of its host hold is removed; a document
    that keeps under ``min_kept`` percent of its words is rejected, and so is
    one that fails the base rules (under 50 words, or over half of them in
    repeated 3-word windows). Counting sums by (host, line) before the shuffle
    and only hashes move, never texts, so neither a large host nor a line that
    every page of it holds meets in one task.

    Null and empty texts have no words and fail. A null host is a host of its
    own. Rows that repeat an id count as one document for line frequency, and
    each gets its own row. An empty table gives an empty table.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(host_col).cast("string").alias("host"))
    base = base.withColumn("words", words_of(F.col("text")))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    base = base.withColumn("lines", lines)
    n_lines = F.size("lines")
    counts = base.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        "host",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (n_lines - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words")).alias("n_repeat_words"),
        F.transform(
            "lines",
            lambda x: F.struct(F.xxhash64(_line_key(x)).alias("line"), F.size(words_of(x)).alias("n")),
        ).alias("lines"),
    )
    table = materialize(counts, "rule-counts")
    lined = table.select("row", "host", F.explode("lines").alias("x")).select("row", "host", "x.line", "x.n")
    once = table.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: x["line"]))).alias("line"), F.struct("doc_id").alias("doc"))
    ids = once.groupBy("host", "line").agg(F.count_distinct("doc").alias("n_docs"))
    often = ids.where(F.col("n_docs") > max_docs).select(F.col("host").alias("h"), F.col("line").alias("l"))
    removed = lined.join(often, lined.host.eqNullSafe(often.h) & (lined.line == often.l), "left_semi")
    removed = removed.groupBy("row").agg(F.sum("n").alias("gone"))
    joined = table.drop("lines").join(removed, "row", "left")
    gone = F.coalesce("gone", F.lit(0))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    depleted = 100 * (F.col("n_words") - gone) < min_kept * F.col("n_words")
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), gone.cast("long").alias("n_boilerplate_words"),
    )
