"""Terms in texts by character: all terms in one pass over a text, the longest first, none over another."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import cut_lineage, scan

#: Letters of all terms of one automaton (some 100 bytes each in a task); with more the terms are dealt to several.
LIMIT = 4_000_000
_BLANKS, _HANGUL = re.compile(r"\s+"), re.compile("[가-힣]")
# What may not stand beside a term without Hangul, and the plural endings that one may have, in the order they are tried.
_BESIDE, _PLURALS = re.compile("[a-z0-9]"), ("es", "s", "")


def even(text: str | None) -> str:
    """A text in compatible forms (NFKC), with single blanks, case folded."""
    return _BLANKS.sub(" ", unicodedata.normalize("NFKC", text or "")).casefold().strip()


def _end(text: str, at: int, term: str) -> int:
    """Where a term that stands at ``at`` ends with its plural, or -1 if letters stand beside it."""
    end = at + len(term)
    if _HANGUL.search(term):
        return end
    if at and _BESIDE.match(text, at - 1):
        return -1
    for plural in _PLURALS:
        if text.startswith(plural, end) and not _BESIDE.match(text, end + len(plural)):
            return end + len(plural)
    return -1


class Terms:
    """An automaton over the forms of terms, in order of rank: the longest as written first, then by text."""

    def __init__(self, terms: list[str]):
        import ahocorasick

        self.ranked = sorted(terms, key=lambda t: (-len(t), t))
        self.automaton = ahocorasick.Automaton()
        self.of: dict[str, list[int]] = {}
        for rank, term in enumerate(self.ranked):
            if form := even(term):
                self.of.setdefault(form, []).append(rank)
        for form, ranks in self.of.items():
            self.automaton.add_word(form, (form, ranks))
        if self.of:
            self.automaton.make_automaton()

    def found(self, text: str) -> list[tuple[int, int, int]]:
        """(rank, start, end): each term's own places, read from the left without overlap."""
        out, reached = [], {}
        for last, (form, ranks) in self.automaton.iter(text) if self.of else ():
            at = last - len(form) + 1
            if at >= reached.get(form, 0) and (end := _end(text, at, form)) >= 0:
                reached[form] = end
                out += [(rank, at, end) for rank in ranks]
        return out


def _take(covered: tuple, start: int, end: int) -> tuple:
    """Whether a place is free of those taken so far, which are kept in order, and that it is taken then."""
    i = bisect_left(covered, (start, end))
    free = (i == 0 or covered[i - 1][1] <= start) and (i == len(covered) or covered[i][0] >= end)
    if free:
        insort(covered, (start, end))
    return covered, free


def _finding(terms: list[str], alone: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Terms(terms.value)
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                keys, rows = [], []
                for i, text in enumerate(map(even, part.column(1).to_pylist())):
                    covered: list = []
                    for rank, start, end in sorted(known.found(text)):
                        if not alone or _take(covered, start, end)[1]:
                            keys.append(i)
                            rows.append((start, end, known.ranked[rank], text[start:end]))
                columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
                arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.string(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(keys, pa.int64())), *arrays], ["key", "start", "end", "term", "matched"])

    return run


def find_terms(texts: DataFrame, key: str, text: str, terms: DataFrame, term: str = "term", limit: int = LIMIT) -> DataFrame:
    """(key, start, end, term, matched): terms in each text, evened out as ``even`` does it, by character offset in that form.

    A term with Hangul is found inside words, so that particles may follow it;
    any other stands between characters that are no letters or digits of ASCII, and may have
    a plural ending. Longer terms take their places first; a place that overlaps one taken is
    left out. An automaton of all terms finds every place in one pass over a text. The terms' letters are
    counted before they are broadcast; beyond ``limit`` the terms are dealt to several automata
    by hash, one pass each, and the places of one row of texts are taken in a stream in order of the terms' length.

    Null and blank texts and terms have no places, equal terms count once.
    Of terms alike but for case or width the first in order of text takes the place. Keys
    needn't be unique or there: each row of ``texts`` gives its own rows. Empty tables give empty ones.
    """
    known = cut_lineage(terms.select(F.col(term).cast("string").alias("term")).where("term IS NOT NULL").distinct())
    groups = (known.agg(F.sum(F.length("term"))).first()[0] or 0) // limit + 1
    kind = texts.schema[key].dataType.simpleString()
    schema, sc = "start int, end int, term string, matched string", texts.sparkSession.sparkContext
    given = lambda g: sc.broadcast([r.term for r in known.where(F.pmod(F.xxhash64("term"), F.lit(groups)) == g).collect()])
    if groups == 1:
        found = texts.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(_finding(given(0), True), f"key {kind}, {schema}")
        return found.withColumnsRenamed({"key": key})
    rows = cut_lineage(texts.select(F.struct(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key")).alias("key"), F.col(text).cast("string").alias("text")))
    every = None
    for g in range(groups):
        some = rows.mapInArrow(_finding(given(g), False), f"key struct<row:bigint,key:{kind}>, {schema}")
        every = some if every is None else every.unionByName(some)
    flat = every.select(F.col("key.row").alias("_row"), F.col("key.key").alias(key), "start", "end", "term", "matched")
    out = scan(flat, ["_row"], [F.desc(F.length("term")), "term", "start"], "_free", "boolean", list, _take, ["start", "end"])
    return out.where("_free").drop("_free", "_row")


def group_places(found: DataFrame, key: str) -> DataFrame:
    """(key, term, n, places): how often each term stands in each row's text, and where, in order."""
    places = F.array_sort(F.collect_list(F.struct("start", "end")))
    return found.groupBy(key, "term").agg(F.count(F.lit(1)).alias("n"), places.alias("places"))
