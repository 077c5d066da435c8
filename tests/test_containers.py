"""Template files filled, copied and compared; a sink that writes all or nothing."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from docloom.operators.templates import merge_fields
from docloom.sources import containers as C
from docloom.sources import documents as D

NS = 'xmlns:hp="urn:para"'


def container(body, name="Contents/section0.xml", **more):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("mimetype", "application/x")
        z.writestr(name, f'<?xml version="1.0" encoding="UTF-8"?><hp:sec {NS}>{body}</hp:sec>')
        for n, data in more.items():
            z.writestr(n, data)
    return out.getvalue()


def p(*runs):
    return "<hp:p>" + "".join(f"<hp:run>{r if r.startswith('<') else f'<hp:t>{r}</hp:t>'}</hp:run>" for r in runs) + "</hp:p>"


FIELD = '<hp:ctrl><hp:fieldBegin type="CLICK_HERE" name="name" guide="your name"/></hp:ctrl><hp:t>{}</hp:t><hp:ctrl><hp:fieldEnd/></hp:ctrl>'
BODY = p("To {'who'}", ", {“ci", "ty”, bold} ", "end") + p(FIELD.format("your name")) + p("topic1: {'topic1'}") + p("body {'topic1 text'}") + "<hp:tbl><hp:tr><hp:tc>" + p("{'who'} {{'kept'}} {'pair”}") + "</hp:tc></hp:tr></hp:tbl>" + p("last")


def texts_of(spark, content):
    files = spark.createDataFrame([("a.hwpx", bytearray(content))], "path string, content binary")
    return [r.text for r in sorted(D.read_blocks(files).collect(), key=lambda r: r.pos)]


def test_scan_and_fill(spark):
    rows = [("a.hwpx", bytearray(container(BODY, extra="x")), {"who": "Kim {'city'}", "city": "Seoul", "name": "Lee", "topic2": "T2", "topic1 text": "B1", "nowhere": "?", "none": None}, {"topic": 3}, ["more", "and more"]), ("b.hwpx", bytearray(b"no zip"), {"who": "x"}, None, None), ("c.hwpx", bytearray(container(BODY)), None, None, None)]
    table = spark.createDataFrame(rows, "path string, content binary, values map<string,string>, copies map<string,int>, blocks array<string>")
    fields = {(r.path, r.name): r for r in merge_fields(C.scan_fields(table), "path").collect()}
    assert {n for f, n in fields if f == "a.hwpx"} == {"who", "city", "name", "topic1", "topic1 text"}
    assert fields["a.hwpx", "who"].occurrences == 2 and fields["a.hwpx", "name"].source == "field" and not fields["a.hwpx", "name"].filled and fields["a.hwpx", "city"].guide == "bold"
    got = {r.path: r for r in C.fill_files(table).collect()}
    assert got["b.hwpx"].problem == "BadZipFile" and bytes(got["b.hwpx"].content) == b"no zip" and got["b.hwpx"].missing == ["who"]
    assert got["a.hwpx"].missing == ["nowhere"] and got["c.hwpx"].n_filled == 0
    assert texts_of(spark, bytes(got["a.hwpx"].content)) == [
        "To Kim {'city'}, Seoul end", "Lee", "topic1: {'topic1'}", "body B1", "topic1: T2", "body {'topic2 text'}", "topic1: {'topic3'}", "body {'topic3 text'}", "Kim {'city'} {{'kept'}} {'pair”}", "last", "more", "and more",
    ]
    with zipfile.ZipFile(io.BytesIO(bytes(got["a.hwpx"].content))) as z:
        assert z.namelist() == ["mimetype", "Contents/section0.xml", "extra"] and b"<hp:run><hp:t>To Kim" in z.read("Contents/section0.xml")
    assert C.fill_files(table.limit(0)).count() == C.scan_fields(table.limit(0)).count() == 0


def test_integrity(spark):
    whole = container(BODY, a="1")
    kinds = {
        "same": whole, "filled": C.fill(whole, {"who": "x"}, {}, [])[0], "appended": C.fill(whole, {}, {}, ["new"])[0], "member gone": container(BODY), "paragraph gone": container(BODY.replace(p("last"), ""), a="1"),
        "run gone": container(BODY.replace("<hp:run><hp:t>end</hp:t></hp:run>", ""), a="1"), "cut": whole[: len(whole) // 2], "not xml": container(BODY + "<hp:p>", a="1"),
    }
    before = spark.createDataFrame([(k, bytearray(whole)) for k in [*kinds, "lost"]], "path string, content binary")
    after = spark.createDataFrame([(k, bytearray(v)) for k, v in kinds.items()], "path string, content binary")
    got = {r.path: r for r in C.integrity(before, after).collect()}
    assert {k for k, r in got.items() if r.passed} == {"same", "filled", "appended"} and set(got) == {*kinds, "lost"}
    assert (got["same"].missing, got["same"].added, got["run gone"].missing, got["member gone"].missing) == (0, 0, 2, 1) and got["appended"].added == 3


def test_documents_become_files_and_come_back(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 40").select("doc_id", F.trim(F.regexp_replace("text", "[\\s\\x00-\\x1f]+", " ")).alias("text"))
    blank = F.lit(container(p("Text: ", "{'text'}") + p("No. {'id'}"))).alias("content")
    rows = docs.select(F.concat("doc_id", F.lit(".hwpx")).alias("path"), blank, F.create_map(F.lit("text"), F.col("text"), F.lit("id"), F.col("doc_id").cast("string")).alias("values"))
    filled = C.fill_files(rows)
    folder = tmp_path / "out"
    folder.mkdir()
    C.write_files(filled.select(F.col("path").alias("name"), "content"), f"file://{folder}")
    assert len(list(folder.iterdir())) == docs.count()
    back = {(r.path.split("/")[-1], r.pos): r.text for r in D.read_blocks(D.read_files(spark, str(folder))).collect()}
    for r in docs.collect():
        assert back[f"{r.doc_id}.hwpx", 0] == f"Text: {r.text}".strip() and back[f"{r.doc_id}.hwpx", 1] == f"No. {r.doc_id}"


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    rows = spark.range(20).select(F.concat("id", F.when(F.col("id") == 13, F.lit("/x")).otherwise("")).alias("name"), F.lit(b"data").alias("content")).repartition(4)
    with pytest.raises(Exception, match="not a file name"):
        C.write_files(rows, f"file://{tmp_path}")
    assert list(tmp_path.iterdir()) == []


def test_letters_are_filled_once(spark):
    from docloom.plans import QUERIES

    plan = QUERIES["letter_integrity"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapIn") == 3  # filled, and read on either side
