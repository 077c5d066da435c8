"""Container readers on small files made here; streams fed piece by piece."""

import io
import json
import os
import zipfile

import pytest

from docloom.sources import documents as D
from docloom.streaming import ordered as S

P = '<p xmlns="urn:x"><run><t>{}</t></run></p>'


def container(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, xml in parts.items():
            z.writestr(name, xml)
    return out.getvalue()


def test_blocks_in_section_order(spark, tmp_path):
    sections = {f"Contents/section{i}.xml": f"<s>{P.format(f'text {i}')}</s>" for i in (10, 2, 0)}
    (tmp_path / "a.hwpx").write_bytes(container(sections))
    table = "<tbl><tr><tc><p><t>a</t></p></tc><tc><p><t>b</t></p></tc></tr><tr><tc><p><t>c</t></p></tc></tr></tbl>"
    (tmp_path / "b.docx").write_bytes(container({"word/document.xml": f"<d><body>{P.format('top')}{table}</body></d>"}))
    (tmp_path / "broken.docx").write_bytes(b"PK\x03\x04 no zip")
    (tmp_path / "plain.docx").write_bytes(b"no zip at all")
    rows = D.read_blocks(D.read_files(spark, str(tmp_path))).collect()
    of = lambda end: [(r.kind, r.text) for r in sorted(rows, key=lambda r: r.pos) if r.path.endswith(end)]
    assert of("a.hwpx") == [("paragraph", "text 0"), ("paragraph", "text 2"), ("paragraph", "text 10")]
    assert of("b.docx") == [("paragraph", "top"), ("table", "a | b\nc")]
    assert [r.problem for r in rows if r.path.endswith("broken.docx")] == ["BadZipFile"]
    assert not of("plain.docx")


def test_markdown_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([("one", "# Title\n\nText | here\n| a | b |")], "name string, text string")
    D.write_markdown(docs, f"{tmp_path}/out")
    written = next((tmp_path / "out" / "name=one").glob("*.txt"))
    written.rename(tmp_path / "one.md")
    rows = sorted(D.read_markdown(D.read_files(spark, str(tmp_path), "*.md")).collect(), key=lambda r: r.pos)
    assert [(r.kind, r.section, r.text) for r in rows] == [("heading", 1, "Title"), ("paragraph", 0, "Text | here"), ("table", 0, "| a | b |")]


def test_terms(spark, tmp_path):
    (tmp_path / "p1.json").write_text(json.dumps({"items": [{"values": {"name": ["x", "y"]}}, {"values": {"key": ["k"]}}]}))
    assert D.read_terms(spark, str(tmp_path)).count() == 2


def fed(spark, tmp_path, batches, make, schema="k string, seq long, text string"):
    """Rows of each batch written as a file of their own, streamed one file a trigger."""
    source = tmp_path / "in"
    source.mkdir()
    for i, rows in enumerate(batches):
        (source / f"{i}.json").write_text("".join(json.dumps(dict(zip(("k", "seq", "text"), r, strict=True))) + "\n" for r in rows))
        os.utime(source / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))  # files are taken oldest first
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source))
    name = f"out_{tmp_path.name.replace('-', '_')}"
    q = make(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_pieces_come_out_in_order(spark, tmp_path):
    batches = [[("a", 2, "c"), ("a", 1, "b"), ("b", 0, "x")], [("a", 0, "a"), ("a", 2, "again")], [("a", 3, "d"), ("b", 0, "x"), ("b", 2, "z")]]
    rows = fed(spark, tmp_path, batches, lambda s: S.emit_in_order(s, "k", "seq", "text"))
    assert [r.text for r in rows if r.key == "a"] == ["a", "b", "c", "d"]
    assert [r.text for r in rows if r.key == "b"] == ["x"]


@pytest.mark.parametrize("size", [1, 5, 1000])
def test_items_do_not_depend_on_cuts(spark, tmp_path, size):
    text = 'noise {"q": "a } \\" {", "n": {"x": 1}} , {"q": "b"} {"open": '
    pieces = [text[i : i + size] for i in range(0, len(text), size)]
    batches = [[("k", i, p) for i, p in enumerate(pieces)][j::2] for j in range(2)]
    rows = fed(spark, tmp_path, [b for b in batches if b], lambda s: S.completed_items(s, "k", "seq", "text"))
    assert [json.loads(r.item) for r in rows] == [{"q": 'a } " {', "n": {"x": 1}}, {"q": "b"}]
