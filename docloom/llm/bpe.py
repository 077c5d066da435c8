"""Byte-level BPE: merges from a priority queue over linked symbols, and decoding by vocabulary strings."""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .shared import kept, lean, slices
from .token_output import _WS, Encoder, _gather, _Known

#: How a byte-level tokenizer splits text before it merges (fixed value); \s is Unicode's White_Space.
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"
#: Pieces of words that are merged under one queue, and how many a worker keeps with their ids.
TOGETHER, PIECES = 300, 1 << 17


def byte_letters() -> list[str]:
    """The character that stands for each byte in vocabulary strings: printable ones stand for themselves, the others for 256 and up in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


class Vocabulary:
    """A tokenizer file's vocabulary: the bytes of each id, the id of each byte, and for each merge rank its two ids and what they become."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre, decoder = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("decoder") or {}
        plain = not any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback"))
        split = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        if model.get("type") != "BPE" or not plain or not split or decoder.get("type") != "ByteLevel" or spec.get("normalizer"):
            raise ValueError("only byte-level BPE without a normalizer is known here")
        ids: dict[str, int] = model["vocab"]
        pairs = [p.split(" ") if isinstance(p, str) else p for p in model["merges"]]
        letters = byte_letters()
        self.of_byte = np.array([ids.get(c, 0) for c in letters], np.int64)
        self.left, self.right = ([ids[p[k]] for p in pairs] for k in (0, 1))
        self.made = [ids[a + b] for a, b in pairs]
        self.bits = max(ids.values()).bit_length()
        # a pair that stands twice has its last rank
        self.rank = {a << self.bits | b: r for r, (a, b) in enumerate(zip(self.left, self.right, strict=True))}
        self.added = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.size = max([*ids.values(), *self.added.values()]) + 1
        back = {c: b for b, c in enumerate(letters)}
        strings = [b""] * self.size
        for word, i in ids.items():
            strings[i] = bytes(back[c] for c in word)
        for word, i in self.added.items():
            strings[i] = word.encode()
        self.lengths = np.array([len(s) for s in strings], np.int64)
        self.bytes = np.frombuffer(b"".join(strings), np.uint8)
        self.starts = np.cumsum(self.lengths) - self.lengths
        first = np.full((256, 256), -1, np.int64)
        at = {int(i): b for b, i in enumerate(self.of_byte)}
        for r in self.rank.values():
            if self.left[r] in at and self.right[r] in at:
                first[at[self.left[r]], at[self.right[r]]] = r
        self.byte_rank = first.ravel()

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
        """The texts of runs of ids, ``sizes`` long: their vocabulary strings one after the other; an id beyond the vocabulary has none."""
        known = ids < self.size
        ids = np.where(known, ids, 0)
        lengths = self.lengths[ids] * known
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(sizes)])]
        data = _gather(self.bytes, self.starts[ids], lengths)
        texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)])
        try:
            return texts.cast(pa.large_string()).cast(pa.string())
        except pa.ArrowInvalid:  # some bytes are no UTF-8
            return pa.array([t.decode(errors="replace") for t in texts.to_pylist()], pa.string())

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of words, none of which is empty.

        All symbols of all words stand in one doubly linked list, in which a
        border stands after each word: it pairs with nothing. The queue holds a rank
        and a place; the smallest rank goes first, of equal ones the leftmost.
        An entry is stale, and skipped, if another pair starts at its place by
        now, or none.
        """
        lengths = np.array([len(w) for w in words], np.int64)
        data = np.frombuffer(b"\0".join([*words, b""]), np.uint8)
        border = np.zeros(len(data), bool)
        border[np.cumsum(lengths + 1) - 1] = True
        symbols = np.where(border, -1, self.of_byte[data])
        ranks = self.byte_rank[data[:-1].astype(np.int64) * 256 + data[1:]]
        ranks = np.concatenate([np.where(border[:-1] | border[1:], -1, ranks), [-1]])
        places = np.flatnonzero(ranks >= 0)
        shift = len(data).bit_length()  # as few bits as will do: Python is fastest with integers of up to 30
        queue = (ranks[places] << shift | places).tolist()
        heapify(queue)
        pair, symbol = ranks.tolist(), symbols.tolist()  # the rank of the pair that starts at a place, and its first symbol
        after, before = list(range(1, len(data) + 1)), list(range(-1, len(data) - 1))
        made, rank, bits, mask = self.made, self.rank.get, self.bits, (1 << shift) - 1
        while queue:
            entry = heappop(queue)
            i = entry & mask
            r = entry >> shift
            if pair[i] != r:
                continue
            j = after[i]
            new = symbol[i] = made[r]
            symbol[j] = pair[j] = -2  # gone
            j = after[i] = after[j]
            before[j] = i
            then = symbol[j]
            q = pair[i] = rank(new << bits | then, -1) if then >= 0 else -1
            if q >= 0:
                heappush(queue, q << shift | i)
            j = before[i]
            if j >= 0 and (then := symbol[j]) >= 0:
                q = pair[j] = rank(then << bits | new, -1)
                if q >= 0:
                    heappush(queue, q << shift | j)
        out = np.array(symbol, np.int64)
        ends = np.cumsum(out >= 0)[border]
        return np.diff(np.concatenate([[0], ends])), out[out >= 0]


class HeapEncoder(Encoder):
    """The word-by-word encoder of the token files with merges of its own; words that a worker met before come from its bounded table."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.by_word, self.added = True, list(self.vocabulary.added)
        self.dtype = np.dtype("<u2" if self.vocabulary.size <= 1 << 16 else "<u4")
        self.known = _Known(self.dtype)
        self.pattern = regex.compile(PATTERN)
        self._forget()
        self.marks = regex.compile("|".join(regex.escape(x) for x in sorted(self.added, key=len, reverse=True))) if self.added else None

    def _unseen(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of words: the pieces that merges stay within are merged once, however many words hold them."""
        split = self.pattern.findall
        pieces = [[w] if (w[1:] if w[:1] == " " else w).isalpha() and w.isascii() else split(w) for w in words]
        every = list(itertools.chain.from_iterable(pieces))
        if len(self.place) > PIECES:
            self._forget()
        new = [x for x in dict.fromkeys(every) if x not in self.place]
        for at in range(0, len(new), TOGETHER):
            some = new[at : at + TOGETHER]
            n, ids = self.vocabulary.merge([x.encode() for x in some])
            self.place.update(zip(some, range(len(self.place), len(self.place) + len(some)), strict=True))
            self.sizes.append(n)
            self.parts.append(ids.astype(self.dtype))
        self.sizes, self.parts = [np.concatenate(self.sizes)], [np.concatenate(self.parts)]
        sizes, ids = self.sizes[0], self.parts[0]
        places = np.fromiter(map(self.place.__getitem__, every), np.int64, len(every))
        found = sizes[places]
        ends, owners = np.concatenate([[0], np.cumsum(found)]), np.cumsum([0, *map(len, pieces)])
        return np.diff(ends[owners]), _gather(ids, (np.cumsum(sizes) - sizes)[places], found)

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.sizes, self.parts = [np.zeros(0, np.int64)], [np.zeros(0, self.dtype)]

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        """Texts that the word table doesn't serve: runs of space, and texts that hold an added token's string."""
        out = []
        for text in texts:
            parts, at = [np.zeros(0, self.dtype)], 0
            for m in self.marks.finditer(text) if self.marks else ():
                parts += [self._unseen([text[at : m.start()]])[1], np.array([self.vocabulary.added[m[0]]], self.dtype)]
                at = m.end()
            if at < len(text):
                parts.append(self._unseen([text[at:]])[1])
            out.append(np.concatenate(parts))
        return out


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids): each text's ids, packed as little-endian unsigned 32-bit integers.

    The strings of added tokens are those tokens wherever they stand, as in
    the tokenizers library; nothing is added, cut or padded. Rows are neither
    shuffled nor gathered: a task turns about a megabyte of text into ids at a
    time, or one longer text, in pieces.

    Null and empty texts have no ids. Null ids stay null, repeated rows come out each, an
    empty table gives an empty one. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept(f"heap {tokenizer}", lambda: HeapEncoder(tokenizer))
        for b in batches:
            for part in slices(b, 1):
                found = encoder.encode_batch([x or "" for x in part.column(1).to_pylist()])
                packed = pa.array([x.astype("<u4").tobytes() for x in found], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in found], pa.int64()), packed], ["doc_id", "n_tokens", "ids"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lean(run, keep=f"heap {tokenizer}"), f"doc_id {kind}, n_tokens long, ids binary")


def decode(encoded: DataFrame, tokenizer: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``: the text of packed ids, special tokens included.

    Vocabulary strings are bytes, so a character may be made of several; bytes
    that are no UTF-8 become U+FFFD. Null and empty ids give an empty text;
    ids beyond the vocabulary give nothing. A column named ``decoded`` is replaced.
    """
    rows = encoded.drop("decoded")
    at = rows.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(tokenizer)
        for b in batches:
            for part in slices(b, at):
                packed = [x or b"" for x in part.column(at).to_pylist()]
                sizes = np.array([len(x) // 4 for x in packed], np.int64)
                texts = vocabulary.decode(np.frombuffer(b"".join(packed), "<u4"), sizes)
                yield pa.RecordBatch.from_arrays([*part.columns, texts], [*part.schema.names, "decoded"])

    return rows.mapInArrow(lean(run, keep=f"heap {tokenizer}"), StructType([*rows.schema.fields, StructField("decoded", StringType())]))


def unpack(ids: Column) -> Column:
    """Packed ids as an array of longs."""
    hexes = F.hex(ids)
    places = F.sequence(F.lit(0), (F.octet_length(ids) / 4).cast("int") - 1)
    number = lambda i: F.conv(F.concat(*[F.substring(hexes, i * 8 + k, F.lit(2)) for k in (7, 5, 3, 1)]), 16, 10).cast("long")
    return F.when(F.octet_length(ids) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(places, number))
