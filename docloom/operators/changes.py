"""What changed between two versions of a text, word by word."""

from __future__ import annotations

import difflib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Units less alike than this are no pair; so large a part of pairs may be none; a unit with a larger part of changed words changed as a whole.
UNLIKE, STRAY, REWRITTEN = 0.2, 0.2, 0.6
# A word, which a tag parts from what stands beside it, and where a sentence ends.
_WORD = re.compile(r"<[^<>\n]{0,300}>|[^\s<]+|<")
_SENTENCE = re.compile(r"(?<=[.!?。])\s+")
#: Pairs that a task compares before it hands on what it found.
TOGETHER = 200
CHANGE = pa.struct([("before", pa.string()), ("after", pa.string()), *[(c, pa.int32()) for c in ("source_start", "source_end", "target_start", "target_end")]])
CHANGE_DDL = "array<struct<before:string,after:string,source_start:int,source_end:int,target_start:int,target_end:int>>"


def units(text: str) -> list[tuple[int, int]]:
    """(start, end) of sentences; headings, table rows and fences are whole lines."""
    out = []
    for line in re.finditer(r"[^\n]+", text):
        said = line[0].strip()
        whole = said.startswith(("#", "|", "```"))
        cuts = [] if whole else [m.span() for m in _SENTENCE.finditer(line[0])]
        for a, b in zip([0, *(c[1] for c in cuts)], [*(c[0] for c in cuts), len(line[0])], strict=True):
            piece = line[0][a:b]
            if body := piece.strip():
                at = line.start() + a + piece.index(body)
                out.append((at, at + len(body)))
    return out


def _alike(a: str, b: str) -> float:
    """Multiset Jaccard of 3-grams, or of single characters in a text of less than three."""
    left, right = (Counter(x[i : i + 3] for i in range(len(x) - 2)) if len(x) > 2 else Counter(x) for x in ("".join(a.split()), "".join(b.split())))
    union = (left | right).total()
    return (left & right).total() / union if union else 1.0


def _groups(a: str, b: str) -> Iterator[tuple[list, list]]:
    """Units that stand against each other: one by one where nearly all are alike in order, else as an alignment has them."""
    left, right = units(a), units(b)
    text = lambda t, spans: [t[s:e] for s, e in spans]
    if left and len(left) == len(right):
        stray = sum(_alike(x, y) < UNLIKE for x, y in zip(text(a, left), text(b, right), strict=True))
        if stray <= max(1, STRAY * len(left)):
            yield from (([x], [y]) for x, y in zip(left, right, strict=True))
            return
    for tag, i, j, k, m in difflib.SequenceMatcher(None, text(a, left), text(b, right), autojunk=False).get_opcodes():
        if tag != "equal":
            yield left[i:j], right[k:m]


def changes(a: str, b: str) -> list[dict]:
    """Replaced, deleted and inserted words with their places in both texts; a place is null where nothing stands."""
    out = []
    for left, right in _groups(a, b):
        words = [[(m[0], s + m.start(), s + m.end()) for s, e in spans for m in _WORD.finditer(t[s:e])] for t, spans in ((a, left), (b, right))]

        def change(i: int, j: int, k: int, m: int, words=words) -> dict:
            here, there = words[0][i:j], words[1][k:m]
            span = lambda x: (x[0][1], x[-1][2]) if x else (None, None)
            values = (" ".join(w[0] for w in here), " ".join(w[0] for w in there), *span(here), *span(there))
            return dict(zip((f.name for f in CHANGE), values, strict=True))

        steps = difflib.SequenceMatcher(None, *[[w[0] for w in x] for x in words], autojunk=False).get_opcodes()
        steps = [s[1:] for s in steps if s[0] != "equal"]
        touched = max(sum(j - i for i, j, _, _ in steps), sum(m - k for _, _, k, m in steps)) if steps else 0
        if len(steps) > 1 and touched > REWRITTEN * max(map(len, words)):
            steps = [(0, len(words[0]), 0, len(words[1]))]
        out += [change(*s) for s in steps]
    return out


def change_list(pairs: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """(key, before, after, changes) of each pair of texts; null texts are empty. A pair is one row's work, whatever the key."""
    kept = pairs.select(key, *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in (before, after)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (batch.slice(at, TOGETHER) for batch in batches for at in range(0, batch.num_rows, TOGETHER)):
            found = [changes(x, y) for x, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.list_(CHANGE))], [key, before, after, "changes"])

    fields = ", ".join(f"`{n}` {t}" for n, t in kept.dtypes)
    return kept.mapInArrow(run, f"{fields}, changes {CHANGE_DDL}")


def highlighted(pairs: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """(key, n_changes, source, target): both texts with their changed words marked."""
    from .markdown import highlight

    listed = change_list(pairs, key, before, after)
    side = lambda s: F.transform(F.filter("changes", lambda c: c[f"{s}_start"].isNotNull()), lambda c: F.struct(c[f"{s}_start"].alias("start"), c[f"{s}_end"].alias("end")))
    return listed.select(key, F.size("changes").alias("n_changes"), highlight(F.col(before), side("source")).alias("source"), highlight(F.col(after), side("target")).alias("target"))
