"""Tables in files: encodings, quoted cells, workbooks with shared strings, types over all rows."""

import io
import zipfile

import pytest

from docloom.sources import tabular as T

TEXT = '이름,나이,점수,"주 소",\r\n"홍 ""길동""",30,1.5,"서울,\n중구",x\r\n김민준,,2,,\r\n\r\nshort,7\r\n'


def book(**sheets):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns:r="urn:r"><sheets>' + "".join(f'<sheet name="{n}" r:id="i{k}"/>' for k, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="i{k}" Target="worksheets/s{k}.xml"/>' for k in range(len(sheets))) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>name</t></si><si><r><t>two </t></r><r><t>runs</t></r></si></sst>")
        for k, rows in enumerate(sheets.values()):
            z.writestr(f"xl/worksheets/s{k}.xml", f"<worksheet><sheetData>{rows}</sheetData></worksheet>")
    return out.getvalue()


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "cp949", "utf-16", "utf-16-le", "utf-16-be"])
def test_csv_in_any_encoding(spark, encoding):
    assert T.decoded(TEXT.encode(encoding))[0] == TEXT
    files = spark.createDataFrame([("a.csv", bytearray(TEXT.encode(encoding)))], "path string, content binary")
    rows = sorted(T.read_rows(files).collect(), key=lambda r: r.row)
    assert [r.cells for r in rows] == [["이름", "나이", "점수", "주 소", None], ['홍 "길동"', "30", "1.5", "서울,\n중구", "x"], ["김민준", None, "2", None, None], ["short", "7"]]


def test_books_types_and_problems(spark):
    one = '<row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>n</t></is></c><c r="D1" t="inlineStr"><is><t>ok</t></is></c></row><row/><row><c r="A3" t="s"><v>1</v></c><c r="C3"><v>4.50</v></c><c r="D3" t="b"><v>1</v></c></row><row><c r="C4"><v>3</v></c></row>'
    files = [("b.xlsx", book(first=one, second='<row><c r="AB1"><v>1</v></c></row>')), ("bad.xlsx", b"PK\x03\x04 no"), ("e.csv", b""), ("shared.xlsx", book(s='<row><c r="A1" t="s"><v>9</v></c></row>')), ("d.csv", b"when,n,n\n2020-01-02,1,x\n2021-01-01 10:00,-2,\n"), (None, b"a\n1\n")]
    table = spark.createDataFrame([(p, bytearray(c)) for p, c in files] + [("null.csv", None)], "path string, content binary").repartition(3)
    rows = T.read_rows(table)
    got = {(r.path, r.sheet, r.row): r.cells for r in rows.where("problem IS NULL").collect()}
    assert got["b.xlsx", "first", 0] == ["name", None, "n", "ok"] and got["b.xlsx", "first", 1] == ["two runs", None, "4.50", "true"] and got["b.xlsx", "first", 2] == [None, None, "3"] and len(got["b.xlsx", "second", 0]) == 28
    assert {(r.path, r.problem) for r in rows.where("problem IS NOT NULL").collect()} == {("bad.xlsx", "BadZipFile"), ("shared.xlsx", "IndexError")}
    cells = T.cells_of(rows)
    types = {(r.path, r.sheet, r.col): (r.name, r.type, r.n, r.nulls) for r in T.infer_types(cells).collect()}
    assert types == {
        ("b.xlsx", "first", 0): ("name", "VARCHAR(18)", 2, 1), ("b.xlsx", "first", 1): ("Unnamed: 1", "VARCHAR(14)", 2, 2), ("b.xlsx", "first", 2): ("n", "FLOAT", 2, 0), ("b.xlsx", "first", 3): ("ok", "BOOLEAN", 2, 1),
        ("d.csv", "table_1", 0): ("when", "DATE", 2, 0), ("d.csv", "table_1", 1): ("n", "BIGINT", 2, 0), ("d.csv", "table_1", 2): ("n", "VARCHAR(14)", 2, 1), (None, "table_1", 0): ("a", "BIGINT", 1, 0),
    }
    records = {(r.path, r.sheet, r.row): r.record for r in T.records(cells).collect()}
    assert records["b.xlsx", "first", 2] == {"name": "null", "Unnamed: 1": "null", "n": "3", "ok": "null"} and records["d.csv", "table_1", 1] == {"when": "2020-01-02", "n": "x"}
    assert T.read_rows(table.limit(0)).count() == 0
