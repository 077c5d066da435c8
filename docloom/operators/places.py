"""Where pieces of a text stand in another version of it: evenly spaced probes, their places, and the chain that keeps their order."""

from __future__ import annotations

import itertools
from bisect import bisect_left, bisect_right

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import letters_only
from .ordered import scan

# Characters of a probe, probes of a piece, how far back of the piece before the search begins, and the share of pieces that must be found.
PROBE, PROBES, BACK, FOUND = 16, 24, 2000, 0.5
SHORTEST = 4
# Fixed value: so many characters are searched through without an index.
PLAIN = 8000


def probes(text: Column, size: int = PROBE, limit: int = PROBES) -> Column:
    """Array of probes: ``size`` characters each, evenly spaced from a text's start to its end; a short text is its own probe, a null one has none."""
    n = F.length(text)
    count = F.greatest(F.lit(1), F.least(F.lit(limit), F.floor(n / size))).cast("int")
    step = (n - size) / F.greatest(count - 1, F.lit(1))
    starts = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.when(count == 1, 0).otherwise(F.bround(i * step)).cast("int"))
    spread = F.transform(starts, lambda a: F.substring(text, a + 1, F.lit(size)))
    short = F.when(F.coalesce(n, F.lit(0)) >= SHORTEST, F.array(text)).otherwise(F.array().cast("array<string>"))
    return F.when(text.isNull() | (n <= size), short).otherwise(spread)


def probes_of(text: str, size: int = PROBE, limit: int = PROBES) -> list[str]:
    """What ``probes`` gives, of a text that a task holds."""
    if len(text) <= size:
        return [text] if len(text) >= SHORTEST else []
    count = max(1, min(limit, len(text) // size))
    step = (len(text) - size) / max(count - 1, 1)
    return [text[a : a + size] for a in (round(i * step) for i in range(count))]


class Seeds:
    """All places of a text's n-grams, so that a probe is looked up: in short texts and near the start by a plain search, else by sorted hashes of every place."""

    def __init__(self, text: str, size: int):
        self.text, self.size, self.order = text, size, None

    def _hash(self, letters: np.ndarray) -> np.ndarray:
        n = max(letters.shape[-1] - self.size + 1, 0)
        out = np.zeros((*letters.shape[:-1], n), np.uint64)
        for i in range(self.size):
            out = out * np.uint64(0x9E3779B97F4A7C15) + letters[..., i : i + n]
        return out

    def _letters(self, text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)

    def find(self, probe: str, start: int) -> int:
        """The first place at or after ``start``, else the first at all; -1 if there is none."""
        return self.find_all([probe], start)[0]

    def find_all(self, probes: list[str], start: int) -> list[int]:
        """The same for each of some probes, which are looked up together."""
        whole = len(self.text) <= PLAIN
        out = [self.text.find(p, start, len(self.text) if whole or len(p) != self.size else start + PLAIN) for p in probes]
        rest = [i for i, at in enumerate(out) if at < 0]
        if rest and start:
            for i in rest:
                if whole or len(probes[i]) != self.size:
                    out[i] = self.text.find(probes[i])
        rest = [] if whole else [i for i in rest if len(probes[i]) == self.size]
        if rest:
            if self.order is None:
                hashes = self._hash(self._letters(self.text))
                self.order = np.argsort(hashes, kind="stable")
                self.sorted = hashes[self.order]
            wanted = self._hash(self._letters("".join(probes[i] for i in rest)).reshape(len(rest), self.size))[:, 0]
            first, last = np.searchsorted(self.sorted, wanted), np.searchsorted(self.sorted, wanted, "right")
            for i, a, z in zip(rest, first.tolist(), last.tolist(), strict=True):
                places = self.order[a:z]
                after = int(np.searchsorted(places, start))
                out[i] = next((at for at in itertools.chain(map(int, places[after:]), map(int, places[:after])) if self.text.startswith(probes[i], at)), -1)
        return out


def chain(starts: list[int]) -> list[int]:
    """Indexes of the longest run of starts that never falls, of equally long ones the one whose members come first.

    By patience: level k holds, in order, the members that end a chain of k;
    within a level starts fall, so a member's place and its forerunner are
    found by halving.
    """
    levels: list[list[int]] = []  # starts negated, so that they rise
    members: list[list[int]] = []
    ends: list[int] = []  # the smallest start of each level
    before: list[int] = []
    best = -1
    for i, s in enumerate(starts):
        k = bisect_right(ends, s)
        before.append(members[k - 1][bisect_left(levels[k - 1], -s)] if k else -1)
        if k == len(ends):
            levels.append([])
            members.append([])
            ends.append(s)
            best = i
        levels[k].append(-s)
        members[k].append(i)
        ends[k] = s
    out = []
    while best >= 0:
        out.append(best)
        best = before[best]
    return out[::-1]


def span_of(seeds: Seeds, wanted: list[str], length: int, cursor: int) -> tuple[int, int] | None:
    """(start, end) of a piece from the places of its probes: those near their median, and of those the longest chain in order."""
    found = [(at, at + len(p)) for p, at in zip(wanted, seeds.find_all(wanted, max(0, cursor - BACK)), strict=True) if at >= 0]
    if not found:
        return None
    middle = sorted(at for at, _ in found)[len(found) // 2]
    near = [x for x in found if abs(x[0] - middle) <= 2 * length + 200]
    kept = [near[i] for i in chain([at for at, _ in near])]
    return kept[0][0], max(end for _, end in kept)


def _step(state: tuple, side: int, text: str | None) -> tuple:
    seeds, cursor = state
    if side == 0:
        return (Seeds(text, PROBE), 0), None
    span = None if seeds is None or not text else span_of(seeds, probes_of(text), len(text), cursor)
    return (seeds, cursor if span is None else span[0]), span


def locate(pieces: DataFrame, texts: DataFrame, doc: str, order: str, piece: str = "text", text: str = "text") -> DataFrame:
    """``pieces`` with ``start`` and ``end``: where each stands in its document's text, both as ``letters_only`` has them.

    Up to 24 probes of a piece are looked up in an index of the text's
    16-grams, first from a little before where the piece before it was found.
    Probes far from their median go, and of the rest those out of order, so a sentence that
    the text repeats elsewhere doesn't pull a piece away. A document's text and then
    its pieces in order are streamed through one task, which holds that one text and
    its index if it is a long one (some 30 bytes a character), never its pieces.

    Null where none of its probes is found, as of null and very short pieces, and where the
    document has no text. Of several texts of one document each piece meets
    the last in order; null documents are one. Repeated pieces each get a row; ties in ``order`` go by the piece. Empty tables give empty ones.
    """
    rows = pieces.withColumns({"_side": F.lit(1), "_text": letters_only(F.col(piece)), "_at": F.col(order)})
    whole = texts.select(F.col(doc), F.lit(0).alias("_side"), F.coalesce(letters_only(F.col(text)), F.lit("")).alias("_text"))
    both = rows.unionByName(whole, allowMissingColumns=True)
    found = scan(both, [doc], ["_side", "_at", piece, "_text"], "_span", "struct<start:int,end:int>", lambda: (None, 0), _step, ["_side", "_text"])
    return found.where("_side = 1").select(*pieces.columns, F.col("_span.start").alias("start"), F.col("_span.end").alias("end"))


def pages_of_pieces(located: DataFrame, starts: DataFrame, doc: str, order: str, least: float = FOUND) -> DataFrame:
    """(doc, order, first_page, last_page, matched): pages of located pieces; a piece that wasn't found takes the first page of the one before it, or of the first found.

    ``starts`` has (doc, page, start): where each page of a document begins in its
    text. Documents of which fewer than ``least`` of the pieces were found have null pages.
    """
    from .layout import pages_of

    ends = located.select(doc, order, F.explode(F.array(F.struct(F.lit(0).alias("_e"), F.col("start").alias("at")), F.struct(F.lit(1).alias("_e"), (F.col("end") - 1).alias("at")))).alias("x")).select(doc, order, "x.*")
    paged = pages_of(ends, starts, doc, "at", "page").groupBy(doc, order).agg(F.max(F.when(F.col("_e") == 0, F.col("page"))).alias("first_page"), F.max(F.when(F.col("_e") == 1, F.col("page"))).alias("last_page"))
    w = Window.partitionBy(doc)
    rows = paged.withColumn("matched", F.avg(F.col("first_page").isNotNull().cast("int")).over(w))
    last = F.last("first_page", ignorenulls=True).over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    first = F.min(F.when(F.col("first_page").isNotNull(), F.struct(order, "first_page"))).over(w)["first_page"]
    good = lambda c: F.when(F.col("matched") >= least, c)
    filled = F.coalesce(last, first)
    return rows.select(doc, order, good(filled).alias("first_page"), good(F.when(F.col("last_page").isNotNull(), F.col("last_page")).otherwise(filled)).alias("last_page"), "matched")
