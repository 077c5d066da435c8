"""Merged cells against a plain occupancy grid, and office tables read from files made here."""

import io
import random
import zipfile

import pytest

from docloom.operators import tables as T
from docloom.sources import documents as D

SCHEMA = "doc int, row int, cell int, row_span int, col_span int, at_row int, at_col int, text string, top string"


def plain_places(cells):
    """Each cell's place with a set of all covered places."""
    taken, out, now, cursor = set(), {}, None, 0
    for _, row, cell, tall, wide, ar, ac, *_ in sorted(cells, key=lambda c: (c[1] or 0, c[2])):
        tall, wide = max(tall or 1, 1), max(wide or 1, 1)
        ar, ac = (-1 if x is None else x for x in (ar, ac))
        row = row or 0
        if row != now:
            now, cursor = row, 0
        r, c = ar if ar >= 0 else row, ac if ac >= 0 else cursor
        while ar < 0 and ac < 0 and (r, c) in taken:
            c += 1
        taken |= {(r + i, c + j) for i in range(tall) for j in range(wide)}
        cursor = c + wide
        out[row, cell] = (r, c, tall, wide)
    return out, taken


def tables_of(rng, addressed):
    rows = []
    for doc in [*range(40), None]:
        for row in range(rng.randint(1, 7)):
            for cell in range(rng.randint(0, 5)):
                at = (rng.randint(0, 8), rng.randint(0, 8)) if addressed and rng.random() < 0.7 else (None, None)
                rows.append((doc, row, cell, rng.choice([1, 1, 1, 2, 3, None, 0]), rng.choice([1, 1, 2, 3, None]), *at, f"{doc} {row} {cell}", "clash"))
    return rows


@pytest.mark.parametrize("addressed", [False, True])
def test_places_equal_an_occupancy_grid(spark, addressed):
    rows = tables_of(random.Random(1 + addressed), addressed)
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    at = {"at_row": "at_row", "at_col": "at_col"} if addressed else {}
    placed = T.place_cells(table, ["doc"], **at)
    got = {}
    for r in placed.collect():
        got.setdefault(r.doc, {})[r.row, r.cell] = (r.top, r.left, r.height, r.width)
    places = {}
    for r in T.grid(placed, ["doc"]).collect():
        places.setdefault(r.doc, []).append((r.row, r.col, r.is_anchor))
    for doc in {r[0] for r in rows}:
        want, taken = plain_places([r for r in rows if r[0] == doc])
        anchors = {x[:2] for x in want.values()}
        assert got[doc] == want
        assert sorted(places[doc]) == sorted((*p, p in anchors) for p in taken)


def plain_html(cells):
    places, taken = plain_places(cells)
    texts = {places[c[1] or 0, c[2]][:2]: (c[7], places[c[1] or 0, c[2]]) for c in sorted(cells, key=lambda c: c[2])}
    height, width = max(r + h for r, _, h, _ in places.values()), max(c + w for _, c, _, w in places.values())
    out = ""
    for r in range(height):
        tag = "th" if r == 0 else "td"
        out += "<tr>"
        for c in range(width):
            if (r, c) in texts:
                text, (_, _, tall, wide) = texts[r, c]
                out += f"<{tag}" + f' rowspan="{tall}"' * (tall > 1) + f' colspan="{wide}"' * (wide > 1) + f">{text}</{tag}>"
            elif (r, c) not in taken:
                out += f"<{tag}></{tag}>"
        out += "</tr>"
    return f"<table><tbody>{out}</tbody></table>"


def test_html_equals_a_plain_rendering(spark):
    rows = tables_of(random.Random(7), False)
    got = {r.doc: r.html for r in T.table_html(T.place_cells(spark.createDataFrame(rows, SCHEMA).drop("top"), ["doc"]), ["doc"]).collect()}
    assert got == {doc: plain_html([r for r in rows if r[0] == doc]) for doc in {r[0] for r in rows}}
    none = spark.createDataFrame([], SCHEMA)
    placed = T.place_cells(none, ["doc"])
    assert placed.count() == 0 and T.grid(placed, ["doc"]).count() == 0 and T.table_html(placed, ["doc"]).count() == 0


def test_a_table_of_many_rows_needs_no_group(spark):
    rows = spark.range(30_000).selectExpr("1 AS doc", "CAST(id AS int) AS row", "0 AS cell", "CAST(1 + id % 3 AS int) AS row_span", "1 AS col_span")
    placed = T.place_cells(rows, ["doc"])
    assert placed.count() == 30_000 and placed.agg({"left": "max"}).first()[0] <= 2


def test_runs_downwards(spark):
    cells = [
        (1, 0, 0, 1, "restart", "a"), (1, 0, 1, 2, None, "b"), (1, 1, 0, 1, "continue", "x"), (1, 1, 1, 1, "restart", "c"), (1, 1, 2, 1, None, "d & <e>"),
        (1, 2, 0, 1, "continue", "x"), (1, 2, 1, 1, "continue", "x"), (1, 2, 2, 1, None, "f\ng"), (1, 3, 0, 1, None, "h"), (1, 3, 1, 1, "continue", "lost"),
        (None, 0, 0, 1, "restart", "i"), (None, 2, 0, 1, "continue", "after a gap"),
    ]
    table = spark.createDataFrame(cells, "doc int, row int, cell int, col_span int, merge string, text string")
    got = {r.doc: r.html for r in T.table_html(T.merge_down(table, ["doc"]), ["doc"], fill=False).collect()}
    assert got[1] == (
        '<table><tbody><tr><th rowspan="3">a</th><th colspan="2">b</th></tr><tr><td rowspan="3">c</td><td>d &amp; &lt;e&gt;</td></tr>'
        "<tr><td>f<br>g</td></tr><tr><td>h</td></tr></tbody></table>"
    )
    assert got[None] == "<table><tbody><tr><th>i</th></tr></tbody></table>"


def container(name, xml):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(name, xml)
    return out.getvalue()


def cell(text, addr=None, span=None):
    at = f'<hp:cellAddr colAddr="{addr[1]}" rowAddr="{addr[0]}"/>' if addr else ""
    wide = f'<hp:cellSpan colSpan="{span[1]}" rowSpan="{span[0]}"/>' if span else ""
    return f"<hp:tc>{at}{wide}<hp:subList>{text}</hp:subList></hp:tc>"


def para(text):
    return f"<hp:p><hp:run><hp:t>{text}</hp:t></hp:run></hp:p>"


def test_merged_cells_of_files(spark, tmp_path):
    inner = "<hp:p><hp:run><hp:t>see</hp:t></hp:run><hp:run><hp:tbl><hp:tr>" + cell(para("n1")) + cell(para("n2")) + "</hp:tr></hp:tbl></hp:run></hp:p>"
    rows = [
        "<hp:tr>" + cell(para("item"), (0, 0)) + cell(para("2025"), (0, 1), (1, 2)) + "</hp:tr>",
        "<hp:tr>" + cell(para("sales"), (1, 0), (2, 1)) + cell(para("1,000"), (1, 1)) + cell(inner, (1, 2)) + "</hp:tr>",
        "<hp:tr>" + cell(para("a|b"), (2, 1)) + "</hp:tr>",
    ]
    bare = "<hp:tbl><hp:tr>" + cell(para("one") + para("two")) + cell(para("r")) + "</hp:tr></hp:tbl>"
    box = "<hp:tbl><hp:tr>" + cell(para("NOTICE")) + "</hp:tr></hp:tbl>"
    body = para("top") + f"<hp:p><hp:run><hp:tbl>{''.join(rows)}</hp:tbl></hp:run></hp:p>" + para("mid") + bare + box
    (tmp_path / "a.hwpx").write_bytes(container("Contents/section0.xml", f'<s xmlns:hp="urn:p">{body}</s>'))
    tc = lambda text, pr="": f"<w:tc><w:tcPr>{pr}</w:tcPr><w:p><w:r><w:t>{text}</w:t></w:r></w:p></w:tc>"
    restart, go_on, wide = '<w:vMerge w:val="restart"/>', "<w:vMerge/>", '<w:gridSpan w:val="2"/>'
    word = f"<w:tbl><w:tr>{tc('h', wide)}{tc('k')}</w:tr><w:tr>{tc('v', restart)}{tc('1')}{tc('2')}</w:tr><w:tr>{tc('', go_on)}{tc('3')}{tc('4')}</w:tr></w:tbl>"
    (tmp_path / "b.docx").write_bytes(container("word/document.xml", f'<w:document xmlns:w="urn:w"><w:body>{word}</w:body></w:document>'))
    files = D.read_files(spark, str(tmp_path))
    blocks = sorted(D.read_blocks(files, merged_cells=True).collect(), key=lambda r: r.pos)
    of = lambda end: [(r.kind, r.text) for r in blocks if r.path.endswith(end)]
    assert of("a.hwpx") == [
        ("paragraph", "top"),
        ("table", '<table><tbody><tr><th>item</th><th colspan="2">2025</th></tr><tr><td rowspan="2">sales</td><td>1,000</td><td>see<br>n1 | n2</td></tr><tr><td>a|b</td><td></td></tr></tbody></table>'),
        ("paragraph", "mid"),
        ("table", "<table><tbody><tr><th>one<br>two</th><th>r</th></tr></tbody></table>"),
        ("box", "NOTICE"),
    ]
    assert of("b.docx") == [("table", '<table><tbody><tr><th colspan="2">h</th><th>k</th></tr><tr><td rowspan="2">v</td><td>1</td><td>2</td></tr><tr><td>3</td><td>4</td></tr></tbody></table>')]


def test_cells_are_worked_out_once_and_partitions_grow(spark):
    from docloom.operators.ordered import parts_for
    from docloom.plans import QUERIES

    plan = QUERIES["merged_table_html"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") == 1 and "Join" not in plan
    assert parts_for(spark.range(1000), 10) == 101


def test_page_lines_are_dealt_by_their_number(spark, monkeypatch):
    from docloom.operators import ordered
    from docloom.plans import QUERIES

    monkeypatch.setattr(ordered, "parts_for", lambda rows: 37)
    plan = QUERIES["page_paragraphs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression [l_orderkey") == 2 and plan.count(", 37") == 2
