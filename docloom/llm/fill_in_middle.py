"""Fill-in-middle samples: a byte automaton finds units and control strings, a second pass finds the cuts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import lean, slices, text_bytes

#: Control strings before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Bytes that one step of a scan looks at, so that a text of any length needs the same memory.
BLOCK = 1 << 18

# Classes of bytes. EDGE is 0xFF, which UTF-8 never uses: it stands between texts.
SPACE, OPEN, NAME, CLOSE, TAIL, OTHER, EDGE = range(7)
# States: outside a unit, in its white space, in its word; in a word also how much of a control string was just read.
START, BLANK, WORD, OPENED, NAMED, SENTINEL = range(6)


def _classes() -> np.ndarray:
    out = np.full(256, OTHER, np.uint8)
    out[[32, *range(9, 14)]] = SPACE
    out[ord("<")], out[ord(">")] = OPEN, CLOSE
    out[[ord(c) for c in "PSM"]] = NAME
    out[0x80:0xC0] = TAIL
    out[0xFF] = EDGE
    return out


def _table() -> np.ndarray:
    """table[state, class]: the next state. A control string in full is a state of its own for one byte."""
    table = np.full((6, 7), WORD, np.uint8)
    table[:, SPACE], table[:, EDGE], table[:, OPEN] = BLANK, START, OPENED
    table[OPENED, NAME], table[NAMED, CLOSE] = NAMED, SENTINEL
    return table


CLASS, TABLE = _classes(), _table()


def _windows(table: np.ndarray) -> np.ndarray:
    """The state after any three classes, which is the same wherever the automaton stood before them."""
    a, b, c = np.meshgrid(*[np.arange(table.shape[1])] * 3, indexing="ij")
    ends = np.array([table[table[table[s, a], b], c] for s in range(len(table))])
    if (ends != ends[0]).any():
        raise ValueError("three bytes don't fix the state")
    return ends[0].ravel()


#: As three classes fix the state, the states of a block follow from table look-ups on its windows, without a loop.
AFTER = _windows(TABLE)


def states(data: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The automaton's state after each byte of ``data``; ``before`` holds the classes of the two bytes before it."""
    kinds = np.concatenate([before, CLASS[data]]).astype(np.int16)
    return AFTER[(kinds[:-2] * 7 + kinds[1:-1]) * 7 + kinds[2:]]


class Scan:
    """One scan over texts joined by EDGE bytes: for each block how many units end and code points begin before it.

    A unit ends where the automaton leaves a word for white space, or meets the
    edge in a word or in white space. ``sentinels`` are the places where a
    control string was complete.
    """

    def __init__(self, joined: bytes):
        self.data = np.frombuffer(joined, np.uint8)
        units, points, found = [0], [0], []
        for at in range(0, len(self.data), BLOCK):
            ends, starts, after = self._block(at)
            units.append(units[-1] + int(ends.sum()))
            points.append(points[-1] + int(starts.sum()))
            found.append(at + np.flatnonzero(after == SENTINEL))
        self.units, self.points = np.array(units), np.array(points)
        self.sentinels = np.concatenate(found) if found else np.zeros(0, np.int64)

    def _block(self, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each byte of a block: does a unit end before it, does a code point start with it, the state after it."""
        data = self.data[at : at + BLOCK]
        # two classes before the block, and the state between them; before all texts lies an edge
        past = CLASS[self.data[max(at - 3, 0) : at]]
        past = np.concatenate([np.full(3 - len(past), EDGE, np.uint8), past])
        after = states(data, past[1:])
        last = AFTER[int(past[0]) * 49 + int(past[1]) * 7 + int(past[2])]
        was, now = np.concatenate([[last], after[:-1]]), after
        ends = ((was >= WORD) & (now <= BLANK)) | ((was == BLANK) & (now == START))
        kind = CLASS[data]
        return ends, (kind != TAIL) & (kind != EDGE), after

    def counts(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Units that end at or before each place, and code points that start before it."""
        blocks = places // BLOCK
        units, points = self.units[np.minimum(blocks, len(self.units) - 1)].copy(), self.points[np.minimum(blocks, len(self.points) - 1)].copy()
        for k in np.unique(blocks[places < len(self.data)]).tolist():
            ends, starts, _ = self._block(k * BLOCK)
            some = np.flatnonzero(blocks == k)
            inside = places[some] - k * BLOCK
            units[some] += np.cumsum(ends)[inside]
            points[some] += np.concatenate([[0], np.cumsum(starts)])[inside]
        return units, points

    def locate(self, numbers: np.ndarray) -> np.ndarray:
        """The place at which the unit of each number (from 1, over all texts) ends."""
        out = np.zeros(len(numbers), np.int64)
        blocks = np.searchsorted(self.units, numbers, "left") - 1
        for k in np.unique(blocks).tolist():
            some = np.flatnonzero(blocks == k)
            ends = np.flatnonzero(self._block(k * BLOCK)[0])
            out[some] = k * BLOCK + ends[numbers[some] - self.units[k] - 1]
        return out


def draws(doc_id: object, seed: int) -> tuple[int, int, int, int]:
    """Four 32-bit integers from a document's id; a null id counts as an empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))


def transform(texts: list[bytes], ids: list, seed: int, rate: int, spm_rate: int) -> tuple[list, ...]:
    """Columns (n, form, prefix_chars, middle_chars, output) of some texts, which are scanned together."""
    texts = [t.decode(errors="replace").encode() if b"\xff" in t else t for t in texts]  # no UTF-8 holds that byte
    scan = Scan(b"\xff".join([*texts, b""]))
    sizes = np.array([len(t) for t in texts], np.int64)
    stops = np.cumsum(sizes + 1) - 1  # each text's edge
    starts = stops - sizes
    ended, points = scan.counts(stops)
    first = np.concatenate([[0], ended[:-1]])  # units of the texts before
    n = ended - first
    marked = np.searchsorted(scan.sentinels, stops) > np.searchsorted(scan.sentinels, starts)
    numbers = np.array([draws(i, seed) for i in ids], np.int64).reshape(-1, 4)
    cuts = np.sort(numbers[:, :2] % (n + 1)[:, None], axis=1)
    plain = (sizes == 0) | marked | (numbers[:, 2] % 100 >= rate)
    spm = numbers[:, 3] % 100 < spm_rate
    places = np.repeat(starts[:, None], 2, axis=1)
    inner = (cuts > 0) & ~plain[:, None]
    places[inner] = scan.locate((first[:, None] + cuts)[inner])
    begun = scan.counts(np.concatenate([starts, places[:, 0], places[:, 1]]))[1].reshape(3, -1)
    forms, outputs = [], []
    for text, p, s, (a, b) in zip(texts, plain.tolist(), spm.tolist(), (places - starts[:, None]).tolist(), strict=True):
        forms.append("plain" if p else "spm" if s else "psm")
        if p:
            outputs.append(text)
        elif s:
            outputs.append(b"".join([SUFFIX, text[b:], PREFIX, text[:a], MIDDLE, text[a:b]]))
        else:
            outputs.append(b"".join([PREFIX, text[:a], SUFFIX, text[b:], MIDDLE, text[a:b]]))
    chars = [pa.array(x, pa.int64(), mask=plain) for x in (begun[1] - begun[0], begun[2] - begun[1])]
    return pa.array(n, pa.int64()), pa.array(forms, pa.string()), *chars, pa.array(outputs, pa.binary()).cast(pa.string(), safe=False)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, rate: int = 50, spm_rate: int = 80) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): each text once, whole or with its middle moved to the end.

    A text's units are its words, each with the white space before it, and the
    white space at its end. ``rate`` percent of the texts are cut at two of
    their units' ends, ``spm_rate`` percent of those with the suffix first; which, and where,
    follows from a hash of the id alone, so reruns agree and no row looks at
    another. Rows are neither shuffled nor gathered; a task holds about a
    megabyte of text, or one text that is longer.

    Null and empty texts are plain and have no units, as are texts that hold a control
    string already. Null ids draw as an empty id. Repeated rows are cut
    alike. An empty table gives an empty one. Other columns are ignored.
    """
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, 1):
                columns = transform(text_bytes(part.column(1)), part.column(0).to_pylist(), seed, rate, spm_rate)
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lean(run), f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made of. No piece holds a control string, so the first of each is the mark itself."""
    # after the mark at the head stand one piece, the second mark, one piece, <M> and the middle
    mark = F.when(form == "psm", F.locate("<S>", output, 4)).otherwise(F.locate("<P>", output, 4))
    end = F.locate("<M>", output)
    piece = lambda start, stop: F.substring(output, start, stop - start)
    one, two = piece(F.lit(4), mark), piece(mark + 3, end)
    middle = F.substring(output, end + 3, F.length(output))
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, middle, two)).otherwise(F.concat(two, middle, one))
