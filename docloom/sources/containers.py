"""Template files: slots and fields of zipped documents, filled in place, copied, compared, and written whole or not at all."""

from __future__ import annotations

import copy
import io
import re
import uuid
import zipfile
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..operators.templates import _SLOT, FIELD, QUOTES
from .documents import _tag

PARTS = re.compile(r"(?:Contents/section|word/document)(\d*)\.xml")
_BRACES = re.compile(r"\{\{[^{}\r\n]+\}\}")
_SLOTS = re.compile(_SLOT)


def _tree(xml: bytes) -> ElementTree.Element:
    """A part's tree; its prefixes stay as they are written."""
    for _, (prefix, uri) in ElementTree.iterparse(io.BytesIO(xml), events=("start-ns",)):
        if prefix and not re.fullmatch(r"ns\d+", prefix):
            ElementTree.register_namespace(prefix, uri)
    return ElementTree.fromstring(xml)


def _paragraphs(node: ElementTree.Element) -> Iterator[tuple]:
    """(parent, paragraph, its own nodes): nodes of paragraphs inside it, as those of tables, are not its own."""
    for child in node:
        if _tag(child) == "p":
            yield node, child, list(_own(child))
        yield from _paragraphs(child)


def _own(node: ElementTree.Element) -> Iterator[ElementTree.Element]:
    for child in node:
        if _tag(child) != "p":
            yield child
            yield from _own(child)


def _found(nodes: list) -> list[tuple]:
    """(kind, name, guide or args, text nodes, start, end) of a paragraph's fields and slots; a slot may lie over several runs."""
    out, field, inside = [], None, []
    for x in nodes:
        kind = _tag(x)
        if kind == "fieldBegin" and x.get("type") == FIELD:
            field, inside = x, []
        elif kind == "fieldEnd" and field is not None:
            out.append((FIELD, field.get("name") or "", field.get("guide") or "", inside, 0, sum(len(t.text or "") for t in inside)))
            field = None
        elif kind == "t" and field is not None:
            inside.append(x)
    taken = {id(t) for f in out for t in f[3]}
    texts = [x for x in nodes if _tag(x) == "t" and id(x) not in taken]
    text = "".join(t.text or "" for t in texts)
    for m in () if "{" not in text else _SLOTS.finditer(_BRACES.sub(lambda b: " " * len(b[0]), text)):
        if m[3] in QUOTES[m[1]] and m[2].strip():
            out.append(("SLOT", m[2].strip(), re.sub(r"^[\s,/·|]+|\s+$", "", m[4]), texts, m.start(), m.end()))
    return out


def _put(texts: list, start: int, end: int, value: str) -> None:
    """``value`` in place of a stretch of the texts' joined characters: it stands in the run in which the stretch begins, and no run goes."""
    at, written = 0, False
    for t in texts:
        said = t.text or ""
        a, b = max(start - at, 0), min(end - at, len(said))
        if a <= len(said) and (b > a or (start == end and not written and a <= len(said))):
            t.text = said[:a] + ("" if written else value) + said[b:]
            written = True
        at += len(said)


def _numbered(name: str, k: int) -> str:
    return re.sub(r"\d+", str(k), name, count=1)


def expand(root: ElementTree.Element, stem: str, copies: int) -> int:
    """Copies of the first run of neighbouring paragraphs that hold a slot ``stem`` + 1, numbered on; returns how many there are then."""
    block: list = []
    for parent, p, nodes in list(_paragraphs(root)):
        holds = any(re.fullmatch(rf"{re.escape(stem)}1(?:\D.*)?", name) for kind, name, *_ in _found(nodes) if kind == "SLOT")
        if holds and (not block or (block[-1][0] is parent and list(parent).index(block[-1][1]) + 1 == list(parent).index(p))):
            block.append((parent, p))
        elif block:
            break
    if not block:
        return 0
    parent, at = block[0][0], list(block[0][0]).index(block[-1][1]) + 1
    for k in range(2, copies + 1):
        for _, p in block:
            new = copy.deepcopy(p)
            for kind, name, _, texts, start, end in reversed(_found(list(_own(new)))):
                if kind == "SLOT":
                    joined = "".join(t.text or "" for t in texts)[start:end]
                    _put(texts, start, end, joined.replace(name, _numbered(name, k), 1))
            parent.insert(at, new)
            at += 1
    return max(copies, 1)


def append(root: ElementTree.Element, blocks: list[str]) -> None:
    """Paragraphs at the end, in the form of the last one with text in it."""
    last = [(parent, p) for parent, p, nodes in _paragraphs(root) if any(_tag(x) == "t" for x in nodes) and parent is root or _tag(parent) == "body"]
    for text in blocks if last else ():
        parent, p = last[-1]
        new = copy.deepcopy(p)
        texts = [x for x in _own(new) if _tag(x) == "t"]
        for t in texts:
            t.text = ""
        if texts:
            texts[0].text = text
        parent.append(new)


def _rewritten(content: bytes, change: Callable[[ElementTree.Element, bool], None]) -> bytes:
    """The container with its document parts changed; all other members as they are, in their order."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = [n for n in z.namelist() if PARTS.fullmatch(n)]
        last = max(names, key=lambda n: int(PARTS.fullmatch(n)[1] or 0), default=None)
        with zipfile.ZipFile(out, "w") as made:
            for info in z.infolist():
                data = z.read(info)
                if info.filename in names:
                    root = _tree(data)
                    change(root, info.filename == last)
                    data = ElementTree.tostring(root, encoding="utf-8", xml_declaration=data.lstrip().startswith(b"<?xml"))
                made.writestr(info, data, compress_type=info.compress_type)
    return out.getvalue()


def fill(content: bytes, values: dict[str, str], copies: dict[str, int], blocks: list[str]) -> tuple[bytes, list[str]]:
    """A filled container and the names that were filled."""
    done: list[str] = []

    def change(root: ElementTree.Element, last: bool) -> None:
        for stem, n in copies.items():
            expand(root, stem, n)
        for _, _, nodes in list(_paragraphs(root)):
            for _, name, _, texts, start, end in reversed(_found(nodes)):
                if values.get(name) is not None:
                    _put(texts, start, end, values[name])
                    done.append(name)
        if last:
            append(root, blocks)

    return _rewritten(content, change), done


FIELDS = "path string, pos int, name string, guide string, field_type string, value string, filled boolean"
FILLED = "path string, content binary, n_filled int, missing array<string>, problem string"
_BROKEN = (zipfile.BadZipFile, ElementTree.ParseError, KeyError)


def _fields_of(content: bytes) -> Iterator[tuple]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for part in sorted((n for n in z.namelist() if PARTS.fullmatch(n)), key=lambda n: int(PARTS.fullmatch(n)[1] or 0)):
            for _, _, nodes in _paragraphs(_tree(z.read(part))):
                for kind, name, guide, texts, start, end in _found(nodes):
                    said = "".join(t.text or "" for t in texts)[start:end] if kind == FIELD else ""
                    yield name, guide, kind, said, kind == FIELD and said.strip() not in ("", guide.strip())


def scan_fields(files: DataFrame) -> DataFrame:
    """(path, pos, name, guide, field_type, value, filled): the slots and form fields of each container in order, for ``templates.merge_fields``.

    A slot is never filled, a form field is if it holds something but its guide. A broken file has none.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    rows += [(path, i, *f) for i, f in enumerate(_fields_of(content or b""))]
                except _BROKEN:
                    continue
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FIELDS.split(", ")])

    return files.select("path", "content").mapInPandas(run, FIELDS)


def fill_files(files: DataFrame) -> DataFrame:
    """(path, content, n_filled, missing, problem): each container filled with its row's values.

    ``files`` has (path, content), ``values`` (a map of names to texts) and, if given,
    ``copies`` (a map of stems to the number of copies of their repeated group) and ``blocks`` (texts that become
    paragraphs at the end). A value stands in the run in which its slot begins, so the form of the text stays; every run, part and member
    of the container stays too. ``missing`` are names without a place. Null values leave their slots; a null map fills nothing.
    A file that can't be read comes back as it was, with its problem.
    """

    kinds = pa.schema([("path", pa.string()), ("content", pa.binary()), ("n_filled", pa.int32()), ("missing", pa.list_(pa.string())), ("problem", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                rows = []
                for path, content, values, copies, blocks in zip(*(c.to_pylist() for c in b.slice(at, 500).columns), strict=True):
                    given = {k: v for k, v in dict(values or ()).items() if v is not None}
                    try:
                        made, done = fill(content or b"", given, dict(copies or ()), blocks or [])
                        rows.append((path, made, len(done), sorted(set(given) - set(done)), None))
                    except _BROKEN as e:
                        rows.append((path, content, 0, sorted(given), type(e).__name__))
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds.types, strict=True)], schema=kinds)

    optional = {"copies": "map<string,int>", "blocks": "array<string>"}
    rows = files.select("path", "content", "values", *[F.col(c) if c in files.columns else F.lit(None).cast(k).alias(c) for c, k in optional.items()])
    return rows.mapInArrow(run, FILLED)


SKELETON = "path string, place string, n bigint"


def _places(content: bytes) -> Iterator[str]:
    """A place for each member of the container and each element of its document parts: the way down to it, without texts."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for name in z.namelist():
            yield name
            if PARTS.fullmatch(name):
                open_ = [(name, _tree(z.read(name)))]
                while open_:
                    above, node = open_.pop()
                    way = f"{above}/{_tag(node)}"
                    yield way
                    open_ += [(way, x) for x in node]


def skeleton(files: DataFrame) -> DataFrame:
    """(path, place, n): members and elements of each container, each place with how many there are; of one that can't be read only the place ``broken``.

    A row without a place stands for the file itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, places = None, []
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part, keys, rows = b.slice(at, 500), [], []
                for i, content in enumerate(part.column(1).to_pylist()):
                    if known != (content or b""):  # copies of one file follow each other
                        known = content or b""
                        try:
                            places = [*Counter(_places(known)).items(), (None, 1)]
                        except _BROKEN:
                            places = [("broken", 1), (None, 1)]
                    keys += [i] * len(places)
                    rows += places
                place, n = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(keys, pa.int64())), pa.array(place, pa.string()), pa.array(n, pa.int64())], ["path", "place", "n"])

    return files.select(F.col("path").cast("string"), "content").mapInArrow(run, SKELETON)


def integrity(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, missing, added, passed): how many members and elements of a container are gone, or new; a row for each path on either side.

    Both skeletons are multisets of places, counted where a file is read and dealt by path once, so each side is
    worked out once and nothing large comes together. What was appended on purpose counts as added: it passes if nothing is missing.
    A file that is on one side only, or broken, fails.
    """
    side = lambda files, a, b: skeleton(files).select("path", "place", (F.col("n") * a).alias("a"), (F.col("n") * b).alias("b"))
    both = side(before, 1, 0).unionByName(side(after, 0, 1)).repartition("path")
    off = both.groupBy("path", "place").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    over = lambda a, b: F.coalesce(F.sum(F.when(F.col("place").isNotNull(), F.greatest(F.col(a) - F.col(b), F.lit(0)))), F.lit(0))
    whole = F.max(F.col("place").isNull() & (F.col("a") > 0) & (F.col("b") > 0))
    broken = F.max(F.coalesce(F.col("place") == "broken", F.lit(False)) & (F.col("b") > F.col("a")))
    out = off.groupBy("path").agg(over("a", "b").alias("missing"), over("b", "a").alias("added"), (whole & ~broken).alias("passed"))
    return out.withColumn("passed", F.col("passed") & (F.col("missing") == 0))


@dataclass
class _Written(WriterCommitMessage):
    files: list


class _FileWriter(DataSourceWriter):
    """Files under a folder of their own until all tasks are through; then they move to their names, or all go."""

    def __init__(self, folder: str, names: list[str]):
        self.folder, self.names = folder.rstrip("/"), names
        self.staged = f"{self.folder}/.staged-{uuid.uuid4().hex}"

    @staticmethod
    def _at(uri: str):
        from pyarrow import fs

        return fs.FileSystem.from_uri(uri)

    def write(self, iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        filesystem, base = self._at(self.staged)
        mine, files = f"{base}/{TaskContext.get().taskAttemptId()}", []
        filesystem.create_dir(mine, recursive=True)
        name, content = self.names.index("name"), self.names.index("content")
        for i, row in enumerate(iterator):
            if "/" in row[name] or row[name].startswith("."):
                raise ValueError(f"not a file name: {row[name]}")
            with filesystem.open_output_stream(f"{mine}/{i}") as sink:
                sink.write(row[content])
            files.append((f"{mine}/{i}", row[name]))
        return _Written(files)

    def commit(self, messages) -> None:
        filesystem, base = self._at(self.folder)
        for message in messages:
            for staged, name in message.files if message else ():
                filesystem.move(staged, f"{base}/{name}")
        filesystem.delete_dir(self._at(self.staged)[1])

    def abort(self, messages) -> None:
        from pyarrow import fs

        filesystem, staged = self._at(self.staged)
        if filesystem.get_file_info(staged).type != fs.FileType.NotFound:
            filesystem.delete_dir(staged)


class FilesSource(DataSource):
    """Sink ``docfiles``: each row (name, content) is a file in the folder that ``path`` names, a URI that all tasks reach."""

    @classmethod
    def name(cls) -> str:
        return "docfiles"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _FileWriter(self.options["path"], schema.names)


def write_files(files: DataFrame, folder: str) -> None:
    """Rows (name, content) as files under ``folder``: all of them once every task is through, none if one fails."""
    files.sparkSession.dataSource.register(FilesSource)
    files.select("name", "content").write.format("docfiles").mode("append").option("path", folder).save()
