"""Dictionary terms in texts: word forms are matched once for each distinct word, terms by an automaton over the words of a text."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.language import MARKS, SAME_MARKS, TOKEN, is_mark, plain, raw_tokens, strip_ending, strip_particle, tokens, verb_stems
from ..functions.text import let
from .ordered import cut_lineage

#: Parts of terms, or words that fit them, up to which every task gets all of them (some 200 bytes each); with more a block of texts gets those of its words.
LIMIT = 25_000
#: Rows of a block, as a power of two.
BLOCK = 10
#: Pairs of words whose longest matches an automaton keeps; later pairs are walked each time. Some 300 bytes each.
KNOWN = 50_000
#: Matches that go on as one Arrow batch, however many one text or some texts have.
FOUND = 50_000


def index_terms(terms: DataFrame, term: str = "term") -> DataFrame:
    """``terms`` with ``_parts``: a term's words and marks, each with whether a number stands before it. Terms without words are left out."""
    def parts(t: Column) -> Column:
        return F.transform(t, lambda x, i: F.struct(x.alias("t"), F.coalesce((i > 0) & F.get(t, i - 1).rlike("^[0-9]+$"), F.lit(False)).alias("d"), is_mark(x).alias("mark")))

    return terms.withColumn("_parts", let(tokens(F.col(term)), parts)).where(F.exists("_parts", lambda p: ~p["mark"]))


def _forms(word: Column) -> Column:
    """What a word of a text may stand for in a term, each with whether that holds only after a number (true), only elsewhere (false), or anywhere (null)."""
    form = lambda x, only: F.struct(x.alias("form"), F.lit(only).cast("boolean").alias("only"))
    simple = F.array(form(word, None), form(strip_ending(word), None), form(strip_particle(word), False), form(strip_particle(word, 1), True))
    return F.array_distinct(F.concat(simple, F.transform(verb_stems(word), lambda x: form(x, None))))


def fitting_words(texts: DataFrame, text: str, index: DataFrame) -> DataFrame:
    """(word, t, d): the distinct words of the texts that fit a part of a term; tasks sum words up before the shuffle."""
    parts = index.select(F.explode("_parts").alias("p")).where("NOT p.mark").select("p.t", "p.d").distinct()
    words = texts.select(F.explode(raw_tokens(F.col(text))).alias("word")).distinct()
    met = words.withColumn("f", F.explode(_forms(plain(F.col("word")))))
    fits = (F.col("f.form") == F.col("t")) & (F.col("f.only").isNull() | (F.col("f.only") == F.col("d")))
    return met.join(parts, fits).select("word", "t", "d").distinct()


_SAME = str.maketrans(MARKS, SAME_MARKS[: len(MARKS)])


class Automaton:
    """Terms as a tree of parts, walked from each word of a text that begins one.

    A mark in the text ends a term; one in the term may be there or not.
    """

    def __init__(self, terms: list[tuple[str, list[tuple[str, bool, bool]]]], words: list[tuple[str, str, bool]]):
        self.fits: dict[str, list] = {}
        for word, t, d in words:
            self.fits.setdefault(word, []).append((t, d))
        self.root: tuple = ({}, {}, [])  # by part, by mark, terms that end here
        for term, parts in terms:
            node = self.root
            for t, d, mark in parts:
                node = node[1].setdefault(t, ({}, {}, [])) if mark else node[0].setdefault((t, d), ({}, {}, []))
            node[2].append(term)
        # a term may begin with marks, which no text needs to have
        starts: dict[tuple, list] = {}
        open_ = [self.root]
        while open_:
            by_part, by_mark, _ = open_.pop()
            for part, node in by_part.items():
                starts.setdefault(part, []).append(node)
            open_ += by_mark.values()
        # the words that begin a term, and what may go on in one: all other words of a text are passed by
        begins = {word: [node for part in parts for node in starts.get(part, ())] for word, parts in self.fits.items()}
        self.begins = {word: nodes for word, nodes in begins.items() if nodes}
        marks = {t for _, parts in terms for t, _, mark in parts if mark}
        self.goes_on = {*self.fits, *marks, *(m for m in MARKS if m.translate(_SAME) in marks)}
        self.known: dict[tuple, tuple] = {}

    def longest(self, said: list[str], start: int) -> tuple[int, list[str]]:
        """(n, terms): the most tokens that terms match from a place on, and which do; 0 without any."""
        nodes = self.begins.get(said[start])
        if nodes is None:
            return 0, []
        after = said[start + 1] if start + 1 < len(said) else ""
        pair = (said[start], after if after in self.goes_on else "")
        if (known := self.known.get(pair)) is not None:
            return known
        best, terms, seen = 0, set(), start
        open_ = [(node, start + 1) for node in nodes]
        while open_:
            (by_part, by_mark, ends), at = open_.pop()
            if ends and at - start >= best:
                terms = {*terms, *ends} if at - start == best else {*ends}
                best = at - start
            if not (by_part or by_mark):
                continue
            seen = max(seen, at)
            token = said[at] if at < len(said) else ""
            for mark, node in by_mark.items():
                open_.append((node, at + (token.translate(_SAME) == mark)))
            if by_part:
                open_ += [(by_part[part], at + 1) for part in self.fits.get(token, ()) if part in by_part]
        out = (best, sorted(terms))
        if seen <= start + 1 and len(self.known) < KNOWN:  # no later token was looked at, so the same two always give the same
            self.known[pair] = out
        return out

    def matches(self, said: list[str]) -> Iterator[tuple[int, int, list[str]]]:
        """(start, n, terms) by token, read from the left: the longest at each place, none inside another."""
        free = 0
        for start in [i for i, word in enumerate(said) if word in self.begins]:
            if start >= free:
                n, terms = self.longest(said, start)
                if n:
                    yield start, n, terms
                    free = start + n


def _matching(terms: list, words: list, once: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(terms.value, words.value)
        for b in batches:
            yield from _found(b.column(0), ((i, automaton, text.as_py()) for i, text in enumerate(b.column(1))), once)

    return run


_TOKEN = re.compile(TOKEN)


def _found(key: pa.Array, texts: Iterable[tuple[int, Automaton, str | None]], once: bool) -> Iterator[pa.RecordBatch]:
    """(key, start, n, term) of the matches in texts, or (key, term) with each term once a text; a text comes with its place in ``key`` and its automaton.

    Texts are read one by one, and matches go on as soon as they are ``FOUND``.
    """
    kinds = {"key": None, "start": pa.int32(), "n": pa.int32(), "term": pa.string()}
    names = ["key", "term"] if once else [*kinds]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = dict(zip(names, zip(*rows, strict=True), strict=True)) if rows else dict.fromkeys(names, ())
        keys = key.take(pa.array(columns.pop("key"), pa.int64()))
        return pa.RecordBatch.from_arrays([keys, *(pa.array(x, kinds[c]) for c, x in columns.items())], names)

    rows: list[tuple] = []
    for i, automaton, text in texts:
        matches = automaton.matches(_TOKEN.findall(text or ""))
        if once:
            rows += [(i, term) for term in {term for _, _, some in matches for term in some}]
        else:
            for start, n, some in matches:
                rows += [(i, start, n, term) for term in some]
                if len(rows) >= FOUND:
                    yield batch(rows)
                    rows = []
        if len(rows) >= FOUND:
            yield batch(rows)
            rows = []
    yield batch(rows)


def _parts(lists: pa.ListArray) -> Iterator[list[tuple]]:
    """The structs of each list as tuples."""
    every = zip(*[c.to_pylist() for c in lists.flatten().flatten()], strict=True)
    return (list(islice(every, n or 0)) for n in lists.value_lengths().to_pylist())


def _matching_blocks(once: bool):
    """Rows (block, kind, said, parts, key) sorted by block and kind: words that fit parts, then terms, then texts. One block's automaton is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, words, terms, automaton = None, [], [], None

        def texts(part: pa.RecordBatch) -> Iterator[tuple[int, Automaton, str | None]]:
            nonlocal at, words, terms, automaton
            said_here = (x.as_py() for x in part.column(2))
            for i, (block, kind, said, parts) in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), said_here, _parts(part.column(3)), strict=True)):
                if block != at:
                    at, words, terms, automaton = block, [], [], None
                if kind == 0:
                    words += [(said, t, d) for t, d, _ in parts]
                elif kind == 1:
                    terms.append((said, parts))
                else:
                    if automaton is None:
                        automaton, words, terms = Automaton(terms, words), [], []
                    yield i, automaton, said

        for b in batches:
            for start in range(0, b.num_rows, 1000):
                part = b.slice(start, 1000)
                yield from _found(part.column(4), texts(part), once)

    return run


def _match_by_blocks(texts: DataFrame, key: str, text: str, index: DataFrame, words: DataFrame, once: bool) -> DataFrame:
    """The matches where terms are many: a block of rows meets the words it holds, and the terms whose rarest part it holds.

    Nothing is broadcast, and a text is read once however many terms there are.
    """
    rows = texts.select(F.shiftright(F.monotonically_increasing_id(), BLOCK).alias("block"), F.col(key).alias("key"), F.col(text).cast("string").alias("said"))
    rows = cut_lineage(rows)
    said = rows.select("block", F.explode(raw_tokens(F.col("said"))).alias("word")).distinct()
    fits = cut_lineage(said.join(words, "word"))
    held = fits.select("block", "t", "d").distinct()
    spread = held.groupBy("t", "d").agg(F.count(F.lit(1)).alias("n"))
    parts = index.select("term", F.col("_parts").alias("parts"), F.explode(F.filter("_parts", lambda p: ~p["mark"])).alias("p")).select("term", "parts", "p.t", "p.d")
    rarest = parts.join(spread, ["t", "d"]).groupBy("term").agg(F.first("parts").alias("parts"), F.min(F.struct("n", "t", "d")).alias("r")).select("term", "parts", "r.t", "r.d")
    here = held.join(rarest, ["t", "d"])
    none = F.lit(None).cast(texts.schema[key].dataType)
    kind = "array<struct<t:string,d:boolean,mark:boolean>>"
    part = F.struct("t", "d", F.lit(False).alias("mark"))
    every = fits.groupBy("block", "word").agg(F.collect_list(part).cast(kind).alias("parts")).select("block", F.lit(0).alias("kind"), F.col("word").alias("said"), "parts", none.alias("key"))
    every = every.unionByName(here.select("block", F.lit(1).alias("kind"), F.col("term").alias("said"), F.col("parts").cast(kind).alias("parts"), none.alias("key")))
    every = every.unionByName(rows.select("block", F.lit(2).alias("kind"), "said", F.array().cast(kind).alias("parts"), "key"))
    every = every.repartition("block").sortWithinPartitions("block", "kind").select("block", "kind", "said", "parts", "key")
    found = every.mapInArrow(_matching_blocks(once), f"key {texts.schema[key].dataType.simpleString()}, {'' if once else 'start int, n int, '}term string")
    return found.withColumnsRenamed({"key": key})


def match_terms(texts: DataFrame, key: str, text: str, terms: DataFrame, term: str = "term", limit: int = LIMIT, once: bool = False) -> DataFrame:
    """(key, start, n, term): terms in each text by token place, longest first, none inside another; with ``once`` (key, term), each once a text.

    Which words of the texts fit which part of a term is worked out over the
    distinct words. The words that fit, and the terms, make an automaton that runs
    over whole texts, so no places are joined or shuffled. Up to ``limit`` it
    is broadcast; beyond, every block of rows gets one of the terms it may hold.

    Terms that match the same tokens are all given. Null texts, null terms and terms without words
    have no matches; equal terms count once. Keys needn't be unique or there:
    each row of ``texts`` is matched by itself and gives its own rows. Empty tables give empty ones.
    """
    index = cut_lineage(index_terms(terms.select(F.col(term).alias("term")).distinct(), "term"))
    words = cut_lineage(fitting_words(texts, text, index))
    parts = index.agg(F.sum(F.size("_parts"))).first()[0] or 0
    if max(parts, words.count()) > limit:
        return _match_by_blocks(texts, key, text, index, words, once)
    given = [(r.term, [tuple(p) for p in r["_parts"]]) for r in index.collect()]
    sc = texts.sparkSession.sparkContext
    run = _matching(sc.broadcast(given), sc.broadcast([(r.word, r.t, r.d) for r in words.collect()]), once)
    kind = texts.schema[key].dataType.simpleString()
    found = texts.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"key {kind}, {'' if once else 'start int, n int, '}term string")
    return found.withColumnsRenamed({"key": key})


def both_ways(items: DataFrame, source: str, target: str) -> DataFrame:
    """(term, answer) of a dictionary in both directions; of entries equal but for case the first in order stays.

    ``source`` and ``target`` are arrays; backwards only a side's first entry answers.
    """
    there = items.select(F.explode(source).alias("term"), F.get(F.col(target), F.lit(0)).alias("answer"))
    back = items.select(F.explode(target).alias("term"), F.get(F.col(source), F.lit(0)).alias("answer"))
    rows = there.unionByName(back).where("term IS NOT NULL AND answer IS NOT NULL")
    return rows.groupBy(F.lower("term").alias("_k")).agg(F.min(F.struct("term", "answer")).alias("r")).select("r.*")


def usage(matches: DataFrame, key: str, answers: DataFrame, translations: DataFrame, text: str) -> DataFrame:
    """(key, n_terms, applied, compliance): of the terms matched in a text, how many have an answer in its translation.

    A translation holds an answer if it holds the words in a row, found as by
    ``match_terms``. Without matched terms compliance is 1.
    """
    # what matching found is kept: the answers to look for come from it as well as the sums
    wanted = cut_lineage(matches.select(key, "term").distinct().join(answers, "term"))
    said = match_terms(translations, key, text, wanted.select(F.col("answer").alias("term")), once=True).select(key, F.col("term").alias("answer")).distinct()
    hit = wanted.join(said.withColumn("_hit", F.lit(1)), [key, "answer"], "left").groupBy(key, "term").agg(F.max("_hit").alias("_hit"))
    sums = hit.groupBy(key).agg(F.count(F.lit(1)).alias("n_terms"), F.count("_hit").alias("applied"))
    out = translations.select(key).join(sums, key, "left").na.fill(0, ["n_terms", "applied"])
    return out.withColumn("compliance", F.coalesce(F.round(F.col("applied") / F.nullif("n_terms", F.lit(0)), 4), F.lit(1.0)))
