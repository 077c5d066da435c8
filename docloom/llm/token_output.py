"""Token ids in Arrow stream files of equal-length sequences."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import SMALL, kept, lean, materialize, scratch_path, settings, slices

SEQUENCE, ROWS, END_ID = 2048, 256, 2
#: Bytes of text that one file is meant to hold.
PER_FILE = 32 << 20
#: Words whose ids a worker keeps (about 35 bytes each), and characters of a text that are cut into words at once.
KEPT, PIECE = 3 << 18, 1 << 18

#: Unicode White_Space, which is what \s means to the tokenizer (Python's \s also takes 1C to 1F).
_WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_CHUNK = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
_CUT = re.compile(f"(?<=[^{_WS}]) (?=[^{_WS}])")
_SPACES = frozenset(map(chr, (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_RARE = re.compile("[\\t\\x0b-\\r\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")


class _Known:
    """Ids of words met so far, in arrays: a sorted 64-bit hash, 64 more bits to be sure, and a place among the ids."""

    def __init__(self, dtype: np.dtype):
        self.hash, self.check = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.start, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, dtype)

    def find(self, hashes: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """Places of the words, -1 for those not met."""
        if not len(self.hash):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hash, hashes), len(self.hash) - 1)
        return np.where((self.hash[at] == hashes) & (self.check[at] == checks), at, -1)

    def add(self, hashes: np.ndarray, checks: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        if len(self.hash) + len(hashes) > KEPT:
            self.__init__(self.ids.dtype)
        self.hash, self.check = np.r_[self.hash, hashes], np.r_[self.check, checks]
        self.start = np.r_[self.start, len(self.ids) + np.cumsum(sizes) - sizes]
        self.size, self.ids = np.r_[self.size, sizes.astype(np.int32)], np.r_[self.ids, ids]
        order = np.argsort(self.hash, kind="stable")
        self.hash, self.check, self.start, self.size = (x[order] for x in (self.hash, self.check, self.start, self.size))


def _gather(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs ``ids[start : start + size]`` one after the other."""
    ends = np.cumsum(sizes)
    return ids[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


class Encoder:
    """A byte-level BPE of the tokenizers library, with its results kept word by word.

    Such a tokenizer never merges across the start of a word (a run of
    non-spaces with the one space before it), so the ids of a text are those of
    its words and space runs in order, and a word met before need not be
    encoded again. Texts that hold an added token's string, and tokenizers of
another kind, are encoded whole. An encoder belongs to one Python worker, which
    hands it from task to task, and keeps at most ``KEPT`` words.
    """

    def __init__(self, path: str):
        import json
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a process for each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.by_word = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        self.by_word = self.by_word and not spec.get("normalizer") and not spec.get("post_processor")
        self.added = [x["content"] for x in spec.get("added_tokens", [])]
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.newline = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.known = _Known(self.dtype)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, self.dtype) for x in found]

    def _unseen(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of words: joined by newlines, which no word holds and which are a token each, then cut there."""
        sizes, every = [np.zeros(0, np.int64)], [np.zeros(0, self.dtype)]
        for at in range(0, len(words), 500):
            some = words[at : at + 500]
            ids = self._whole(["\n".join(some)])[0]
            cuts = np.flatnonzero(ids == self.newline[0]) if len(self.newline) == 1 else ()
            if len(cuts) == len(some) - 1:
                sizes.append(np.diff(np.r_[-1, cuts, len(ids)]) - 1)
                every.append(np.delete(ids, cuts))
            else:
                found = self._whole(some)
                sizes.append(np.array([len(x) for x in found], np.int64))
                every += found
        return np.concatenate(sizes), np.concatenate(every)

    def _words(self, text: str) -> list[str] | None:
        """Keys of a text's pieces: NUL + a word with no space before it, a word with one, or a space run."""
        if not text:
            return []
        plain = not (text[0].isspace() or text[-1].isspace() or "  " in text or " \n" in text or "\n " in text)
        if plain and "\n\n" not in text and not _RARE.search(text):
            return ("\0" + text.replace("\n", " \n \0")).split(" ")
        return [x[1:] if x[0] == " " and len(x) > 1 and x[1] not in _SPACES else x if x[0] in _SPACES else "\0" + x for x in _CHUNK.findall(text)]

    def _ids_of(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of the pieces with these keys."""
        both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), np.uint64).reshape(-1, 2)
        hashes, first, places = np.unique(both[:, 0], return_index=True, return_inverse=True)
        checks = both[first, 1]
        at = self.known.find(hashes, checks)
        new = np.flatnonzero(at < 0)
        if len(new):
            words = [keys[i] for i in first[new].tolist()]
            space = np.array([w[0] in _SPACES for w in words])
            some = self._whole([w for w, s in zip(words, space, strict=True) if s])
            sizes, ids = self._unseen([w[1:] if w[0] == "\0" else " " + w for w, s in zip(words, space, strict=True) if not s])
            order = np.r_[np.flatnonzero(~space), np.flatnonzero(space)]
            sizes = np.r_[sizes, np.array([len(x) for x in some], np.int64)]
            self.known.add(hashes[new][order], checks[new][order], sizes, np.concatenate([ids, *some]))
            at = self.known.find(hashes, checks)
            if (at < 0).any():  # older words made room
                return self._ids_of(keys)
        at = at[places]
        return self.known.size[at], _gather(self.known.ids, self.known.start[at], self.known.size[at].astype(np.int64))

    def encode(self, text: str) -> list[np.ndarray]:
        return self.encode_batch([text])[0]

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        out: list = [None] * len(texts)
        keys, owners = [], []
        for i, text in enumerate(texts):
            if not self.by_word or "\0" in text or any(x in text for x in self.added):
                out[i] = self._whole([text])[0]
            elif len(text) > PIECE:
                out[i] = np.concatenate([self._ids_of(self._words(x))[1] for x in _pieces(text)])
            else:
                words = self._words(text)
                keys += words
                owners.append((i, len(words)))
        sizes, ids = self._ids_of(keys) if keys else (np.zeros(0, np.int32), np.zeros(0, self.dtype))
        ends = np.r_[0, np.cumsum(sizes, dtype=np.int64)]
        at = 0
        for i, n in owners:
            out[i] = ids[ends[at] : ends[at + n]]
            at += n
        return out


def _pieces(text: str) -> Iterator[str]:
    """A long text in pieces that end before a single space between two words."""
    at = 0
    while at < len(text):
        found = _CUT.search(text, at + PIECE)
        to = found.start() if found else len(text)
        yield text[at:to]
        at = to


def _file(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _schema(dtype: np.dtype, length: int) -> pa.Schema:
    ids = pa.list_(pa.from_numpy_dtype(dtype), length)
    # a byte an item, as Arrow's bits can't be handed out as a numpy view; nearly all masks are the same one, so a dictionary holds them
    return pa.schema([("input_ids", ids), ("mask", pa.dictionary(pa.int32(), pa.list_(pa.uint8(), length)))])


class SequenceWriter:
    """Appends id arrays to a stream file, cut into sequences; only the last may be padded (mask 0)."""

    def __init__(self, sink, dtype: np.dtype, length: int, rows: int):
        self.schema, self.dtype, self.length, self.rows = _schema(dtype, length), dtype, length, rows
        self.stream = pa.ipc.new_stream(sink, self.schema)
        self.parts, self.held = [], 0

    def write(self, ids: np.ndarray) -> None:
        self.parts.append(ids)
        self.held += len(ids)
        block = self.length * self.rows
        if self.held >= block:
            every = np.concatenate(self.parts)
            for at in range(0, len(every) - block + 1, block):
                self._batch(every[at : at + block], block)
            self.parts = [every[len(every) // block * block :]]
            self.held = len(self.parts[0])

    def _batch(self, ids: np.ndarray, real: int) -> None:
        n, last = len(ids) // self.length, real - (len(ids) - self.length)
        padded = last < self.length
        masks = (np.arange(self.length) < np.array([[self.length], [last]])[: 1 + padded]).astype(np.uint8)
        of, kind = np.zeros(n, np.int32), self.schema.types[1]
        of[-1] = padded
        sequences = pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(ids, self.dtype)), type=self.schema.types[0])
        dictionary = pa.FixedSizeListArray.from_arrays(pa.array(masks.ravel()), type=kind.value_type)
        arrays = [sequences, pa.DictionaryArray.from_arrays(pa.array(of), dictionary)]
        self.stream.write_batch(pa.RecordBatch.from_arrays(arrays, schema=self.schema))

    def close(self) -> None:
        if self.held:
            ids = np.concatenate(self.parts)
            self._batch(np.pad(ids, (0, -len(ids) % self.length)), len(ids))
        self.stream.close()


class Sequences:
    """Random access to a written file: ``s[i]`` is (ids, mask) of sequence i, both views of the mapped file.

    All batches but the last hold the same number of sequences, so a
    sequence's batch follows from its number. Local files are memory mapped,
    so only what is asked for is read; a file of another file system, which
    holds about ``PER_FILE`` bytes of text, is read whole.
    """

    def __init__(self, uri: str):
        filesystem, path = _file(uri)
        source = pa.memory_map(path) if filesystem.type_name == "local" else filesystem.open_input_file(path)
        self.batches = list(pa.ipc.open_stream(source))
        self.rows = self.batches[0].num_rows if self.batches else 1
        self.length = self.batches[0].schema.types[0].list_size if self.batches else 1
        self.ids = [b.column(0).flatten().to_numpy() for b in self.batches]
        self.masks = [b.column(1).dictionary.flatten().to_numpy().reshape(-1, self.length) for b in self.batches]
        self.of = [b.column(1).indices.to_numpy() for b in self.batches]

    def __len__(self) -> int:
        return sum(b.num_rows for b in self.batches)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        if not 0 <= i < len(self):
            raise IndexError(i)
        k, at = divmod(i, self.rows)
        return self.ids[k][at * self.length : (at + 1) * self.length], self.masks[k][self.of[k][at]]

    def n_tokens(self) -> int:
        """Ids that aren't padding, by the masks."""
        return sum(int(masks.sum(axis=1, dtype=np.int64)[of].sum()) for masks, of in zip(self.masks, self.of, strict=True))

    def tokens(self, start: int, stop: int) -> Iterator[np.ndarray]:
        """Ids ``start`` to ``stop`` of the file in views, one for each batch they touch."""
        block = self.rows * self.length
        while start < stop:
            k, at = divmod(start, block)
            to = min(at + stop - start, block)
            yield self.ids[k][at:to]
            start += to - at


def _write(folder: str, path: str, end_id: int, length: int, rows: int):
    names = ["part", "path", "n_docs", "n_tokens"]
    index_schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, context = kept(path, lambda: Encoder(path)), TaskContext.get()
        part, end = context.partitionId(), np.array([end_id], encode.dtype)
        filesystem, base = _file(folder)
        filesystem.create_dir(base, recursive=True)
        final = f"{base}/part-{part:06d}"
        tried = f"{base}/.tried-{part:06d}-{context.taskAttemptId()}"
        n_docs = n_tokens = 0
        with filesystem.open_output_stream(tried) as sink, filesystem.open_output_stream(tried + ".index") as index_sink:
            writer = SequenceWriter(sink, encode.dtype, length, rows)
            index = pa.ipc.new_stream(index_sink, index_schema)
            for b in batches:
                sizes = []
                for part_of in slices(b, 1):
                    for ids in encode.encode_batch([x or "" for x in part_of.column(1).to_pylist()]):
                        writer.write(ids)
                        writer.write(end)
                        sizes.append(len(ids) + 1)
                columns = [b.column(0).cast(pa.int64()), pa.array(sizes, pa.int64())]
                index.write_batch(pa.RecordBatch.from_arrays(columns, schema=index_schema))
                n_docs, n_tokens = n_docs + len(sizes), n_tokens + sum(sizes)
            writer.close()
            index.close()
        # whole files only, under a name that a second attempt writes alike
        filesystem.move(tried, final + ".arrow")
        filesystem.move(tried + ".index", final + ".index")
        if n_docs:
            row = [[part], [f"{folder}/part-{part:06d}"], [n_docs], [n_tokens]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in row], names)

    return run


def write_tokens(
    docs: DataFrame,
    tokenizer: str,
    folder: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = END_ID,
    length: int = SEQUENCE,
    rows: int = ROWS,
) -> DataFrame:
    """Encode texts and write them in ascending id order; returns the manifest, a row per file.

    ``docs`` is dealt out by range of (id, hash of the text), so file n holds
    what follows file n-1 and many rows of one id are several files. Each task writes one file: an Arrow stream of batches of
    ``rows`` sequences, two fixed-size-list columns of ``length`` items each,
    ``input_ids`` and ``mask`` (by a dictionary of the masks), plus a small index file with each document's
    id and length. Files are written under a task's own name and then renamed,
    so a retried task leaves one whole file. A file is made of about
    ``PER_FILE`` bytes of text, so that the manifest (path, n_docs, n_tokens,
    base: tokens in all files before) is one small row for each 32 MB; only
    over it the running sum is taken, in one task.

    Null and empty texts are the end id alone. Null ids come first. Rows with
    the same id are all written, in the order of a hash of their texts. An empty table gives an
    empty manifest.
    """
    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    chars = kept.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # by text too, so that rows of one id, or of none, make more than one file
    kept = kept.withColumn("_by", F.xxhash64("text"))
    dealt = kept.repartitionByRange(chars // PER_FILE + 1, "doc_id", "_by").sortWithinPartitions("doc_id", "_by")
    written = dealt.mapInArrow(
        lean(_write(folder, tokenizer, end_id, length, rows), keep=tokenizer), "part long, path string, n_docs long, n_tokens long"
    )
    with settings(docs.sparkSession, SMALL):
        manifest = materialize(written, "manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    for b in batches:
        for path, base, total in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            sequences, at = Sequences(path + ".arrow"), 0
            if sequences.n_tokens() != total:
                raise ValueError(f"{path} holds {sequences.n_tokens()} ids, not {total}")
            filesystem, place = _file(path + ".index")
            with filesystem.open_input_stream(place) as index_source:
                for index in pa.ipc.open_stream(index_source):
                    sizes = index.column(1).to_numpy()
                    starts, crcs = at + np.cumsum(sizes) - sizes, []
                    for start, size in zip(starts.tolist(), sizes.tolist(), strict=True):
                        crc = 0
                        for piece in sequences.tokens(start, start + size):
                            crc = zlib.crc32(piece.astype("<u4"), crc)
                        crcs.append(crc)
                    at += int(sizes.sum())
                    columns = [index.column(0), pa.array(base + starts), index.column(1), pa.array(crcs, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names)


def read_tokens(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, read back from the files of a manifest.

    A document's ids are looked up by their place in the file's sequences,
    through ``Sequences``. A file whose masks don't count as many ids as its
    index is an error. Null ids come back null; an empty manifest gives an
    empty table.
    """
    files = manifest.select("path", "base", "n_tokens").repartition(max(manifest.count(), 1), "path")
    return files.mapInArrow(lean(_read), "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(spark: SparkSession, docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write ``docs`` under a new folder of the shared one and read every document back."""
    return read_tokens(write_tokens(docs, tokenizer, scratch_path(spark, "tokens")))
