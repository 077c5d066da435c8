"""Page headers and footers that are alike but not equal: a similarity join of lines within a document."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .layout import PAGE_NUMBER, RUNNING_PAGES, RUNNING_SHARE, in_margin
from .ordered import cut_lineage, scan
from .tables import _beside

# How alike two keys are, and the letters that a key has at least.
ALIKE, LEAST_KEY = 0.6, 2


def header_key(text: Column) -> Column:
    """A line without blanks, each number as one sign, by which headers are compared from page to page."""
    return F.regexp_replace(F.regexp_replace(text, "(?U)\\s+", ""), "(?U)\\d+", "#")


def _ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """The share of two texts in matching blocks, block by block from the longest."""
    matcher, last, out = difflib.SequenceMatcher(None), None, []
    for a, b in zip(left, right, strict=True):
        if b != last:
            matcher.set_seq2(b)  # what is worked out for it serves all rows that follow with it
            last = b
        matcher.set_seq1(a)
        out.append(matcher.ratio())
    return pd.Series(out)


def _common(mine: Column, other: Column) -> Column:
    """How many letters two keys share, from their (letter, count) arrays."""
    of = F.map_from_entries(other)
    return F.aggregate(mine, F.lit(0).cast("long"), lambda acc, x: acc + F.least(x["n"], F.coalesce(F.try_element_at(of, x["letter"]), F.lit(0).cast("long"))))


def similar_pairs(keys: DataFrame, doc: str, key: str, least: float = ALIKE) -> DataFrame:
    """(doc, key, other): pairs of a document's distinct keys whose matching blocks make up ``least`` of them, each way round, and each key with itself.

    Matching blocks are no more than the letters two keys have in common, and
    those no more than the shorter key. So two keys of a and b letters need a
    common ``least / 2 * (a + b)``, and if they have them they share one of the
    rarest letters of either: letters are joined by an equi-join on the first
    few in order of rarity, the pairs are sifted by length and by common letters, and only what is left
    is compared block by block. No step goes over all pairs.

    The ratio isn't the same both ways for a few texts; a pair counts in the way it is
    written. Null keys and empty ones have no pairs; null documents are one.
    """
    rows = keys.select(F.col(doc).alias("doc"), F.col(key).alias("key")).where("key <> ''").distinct()
    letters = rows.select("doc", "key", F.explode(F.split("key", "")).alias("letter")).where("letter <> ''").groupBy("doc", "key", "letter").agg(F.count(F.lit(1)).alias("n"))
    # a key's letters as a set: each with how often it stood before, as two keys share what their multisets share
    spread = letters.select("doc", "key", "letter", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("again"))
    often = spread.groupBy("doc", "letter", "again").agg(F.count(F.lit(1)).alias("often"))
    mark = F.struct("often", "letter", "again")
    ranked = _beside(spread, often, ["doc", "letter", "again"]).groupBy("doc", "key").agg(F.array_sort(F.collect_list(mark)).alias("marks"))
    ranked = ranked.withColumn("n", F.size("marks"))
    share = least / (2 - least)  # of the longer key that the shorter one has at least
    # the fewest letters that any partner may share: those of the shortest one
    need = F.ceil(F.lit(least / 2) * (F.col("n") + F.ceil(F.col("n") * share - 1e-9)) - 1e-9)
    first = F.slice("marks", F.lit(1), (F.col("n") - need + 1).cast("int"))
    profiles = letters.groupBy("doc", "key").agg(F.collect_list(F.struct("letter", "n")).alias("letters"))
    heads = ranked.select("doc", "key", "n", F.explode(F.transform(first, lambda m: F.struct(m["letter"], m["again"]))).alias("mark"))
    a, b = heads.select("doc", "key", "n", "mark"), heads.select(F.col("doc").alias("d"), F.col("key").alias("other"), F.col("n").alias("m"), F.col("mark").alias("k"))
    sized = (F.least("n", "m") >= F.greatest("n", "m") * share - 1e-9) & (F.col("key") < F.col("other"))
    near = a.join(b, a["doc"].eqNullSafe(b["d"]) & (F.col("mark") == F.col("k")) & sized).select("doc", "key", "other").distinct()
    other = profiles.select("doc", F.col("key").alias("other"), F.col("letters").alias("others"))
    near = _beside(_beside(near, profiles, ["doc", "key"]), other, ["doc", "other"])
    near = near.where(2 * _common(F.col("letters"), F.col("others")) >= least * (F.length("key") + F.length("other")) - 1e-9)
    both = near.select("doc", F.inline(F.array(F.struct("key", "other"), F.struct(F.col("other").alias("key"), F.col("key").alias("other")))))
    ratio = F.pandas_udf(_ratio, DoubleType())
    found = both.where(ratio("key", "other") >= least).unionByName(rows.select("doc", "key", F.col("key").alias("other")))
    return found.withColumnsRenamed({"doc": doc})


def running_headers(lines: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """(doc, key, pages): keys of a document's lines that stand, in this or a similar form, on enough of its pages.

    Enough: three, and a quarter of the pages rounded up. ``lines`` holds the
    margins' lines, or all of them. Pages are counted from the pairs, summed
    by (document, key). Documents of under three pages have none, nor have null texts; null documents are one,
    and lines without a page count as one page. The lines' keys are worked out once and checkpointed, as several steps go over them.
    """
    rows = cut_lineage(lines.select(F.col(doc).alias("doc"), F.coalesce(F.col(page).cast("string"), F.lit("")).alias("page"), header_key(F.col(text)).alias("key")))
    need = rows.groupBy("doc").agg(F.count_distinct("page").alias("n")).select("doc", "n", F.greatest(F.lit(RUNNING_PAGES), F.ceil(F.col("n") * RUNNING_SHARE)).alias("need"))
    keys = rows.where(F.length("key") >= LEAST_KEY).distinct()
    pairs = similar_pairs(keys, "doc", "key").select(F.col("doc").alias("d"), F.col("key").alias("mine"), "other")
    met = keys.join(pairs, keys["doc"].eqNullSafe(pairs["d"]) & (keys["key"] == pairs["other"]))
    found = met.groupBy("doc", F.col("mine")).agg(F.count_distinct("page").alias("pages"))
    out = _beside(found, need, ["doc"]).where("n >= 3 AND pages >= need")
    return out.select(F.col("doc").alias(doc), F.col("mine").alias("key"), "pages")


def _first_alike(known: tuple, key: str) -> tuple:
    for other in known:
        if key == other or difflib.SequenceMatcher(None, key, other).ratio() >= ALIKE:
            return known, other
    return (*known, key), key


def header_forms(running: DataFrame, doc: str) -> DataFrame:
    """(doc, key, form): each running key with the first, by frequency, that it is like: a header's forms under one name."""
    return scan(running.select(doc, "key", "pages"), [doc], [F.desc("pages"), "key"], "form", "string", tuple, _first_alike, ["key"]).select(doc, "key", "form")


def without_headers(lines: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """``lines`` (y0, y1, height) without page numbers and running headers in the margins, whatever form those take on a page."""
    margin = F.coalesce(in_margin(F.col("y0"), F.col("y1"), F.col("height")), F.lit(False))
    found = running_headers(lines.where(margin), doc, page, text).select(doc, F.col("key").alias("_key"), F.lit(True).alias("_running"))
    # the body stays where it is: only the margins' lines meet the headers
    rows = _beside(lines.where(margin).withColumn("_key", header_key(F.col(text))), found, [doc, "_key"])
    drop = F.col(text).rlike(PAGE_NUMBER) | F.coalesce("_running", F.lit(False))
    return rows.where(~F.coalesce(drop, F.lit(False))).select(*lines.columns).unionByName(lines.where(~margin))
