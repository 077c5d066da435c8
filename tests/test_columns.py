"""Column gaps against a plain sweep over points, with filtering until nothing changes."""

import random

import pytest

from docloom.operators import columns as C
from docloom.operators.layout import reading_order


def plain_narrow(lines):
    left, right = min(a for a, _ in lines), max(b for _, b in lines)
    width, middle = right - left, (left + right) / 2
    narrow = [x for x in lines if x[1] - x[0] < width * 0.6]
    edges = {}
    for a, _ in narrow:
        edges[round(a)] = edges.get(round(a), 0) + 1
    return left, right, [(a, b) for a, b in narrow if not (a < middle < b and abs((a + b) / 2 - middle) <= width * 0.05 and edges[round(a)] < 3)]


def plain_gutters(lines):
    if not lines:
        return []
    left, right, narrow = plain_narrow(lines)
    width = right - left
    if width <= 0 or len(narrow) < 6:
        return []
    noise = max(2, int(len(narrow) * 0.1))
    covered = [sum(max(0, int(a - left) + 1) <= cell <= int(b - left) for a, b in narrow) for cell in range(int(width) + 2)]
    lo, hi, found, start = int(width * 0.15), int(width * 0.85), [], None
    for cell in range(int(width) + 2):
        free = lo <= cell <= hi and covered[cell] <= noise
        if free and start is None:
            start = cell
        if not free and start is not None:
            if cell - start >= 6:
                found.append(left + (start + cell) / 2)
            start = None

    def fills(some, wide):
        widths = sorted(b - a for a, b in some)
        return len(some) >= max(3, len(narrow) * 0.15) and wide > 0 and widths[len(widths) // 2] >= wide * 0.5

    while True:
        edges = [left, *found, right]
        kept = [g for i, g in enumerate(found) if fills([x for x in narrow if x[0] >= edges[i] - 1 and x[1] <= g], g - edges[i]) and fills([x for x in narrow if x[0] >= g and x[1] <= edges[i + 2] + 1], edges[i + 2] - g)]
        if kept == found:
            return found
        found = kept


def page(rng, kind):
    wide = {"one": [(50, 500)], "two": [(50, 265), (285, 500)], "three": [(50, 190), (205, 345), (360, 500)], "table": [(50, 70), (150, 170), (250, 300), (400, 500)]}[kind]
    lines = []
    for _ in range(rng.randint(4, 30)):
        for a, b in wide:
            if rng.random() < 0.85:
                lines.append((a + rng.choice([0, 0, 0.4, 6.5]), b - rng.choice([0, 0, 3.3, rng.uniform(0, b - a - 10)])))
    for _ in range(rng.choice([0, 1, 4])):
        lines.append((50.0, 500.0) if rng.random() < 0.5 else (230.0 + rng.random(), 320.0))
    return lines


@pytest.fixture(scope="module")
def pages():
    rng = random.Random(9)
    out = {("d", i): page(rng, rng.choice(["one", "two", "two", "three", "table"])) for i in range(80)}
    return out | {("d", 100): [], ("d", 101): [(5.0, 5.0)] * 9, (None, 1): page(rng, "two"), ("d", None): page(rng, "three")}


def test_gutters_equal_a_plain_sweep(spark, pages):
    rows = [(d, p, float(a), float(b), "x", 0) for (d, p), lines in pages.items() for a, b in lines] + [("d", 102, None, 3.0, "x", 0), ("d", 102, 1.0, None, "x", 0)]
    table = spark.createDataFrame(rows, "doc string, page int, x0 double, x1 double, left string, n int").repartition(5)
    got = {(r.doc, r.page): r.gutters for r in C.gutters(table, ["doc", "page"]).collect()}
    want = {k: g for k, lines in pages.items() if (g := plain_gutters(lines))}
    assert got == want and {len(g) for g in got.values()} >= {1, 2}
    assert C.gutters(table.limit(0), ["doc", "page"]).count() == 0


def test_layouts_of_documents(spark):
    found = [("a", 1, [100.0]), ("a", 2, [250.0]), ("a", 3, [107.0]), ("a", 4, [256.0]), ("a", 5, [258.5]), ("b", 1, [100.0]), ("c", 1, [90.0, 200.0]), ("c", 2, [90.0]), ("c", 3, [98.0, 193.0]), (None, 1, [5.0]), (None, 2, [5.0])]
    table = spark.createDataFrame(found, "doc string, page int, gutters array<double>")
    got = {r.doc: (r.gutters, r.pages) for r in C.document_gutters(table, "doc", "page").collect()}
    assert got == {"a": ([100.0], 2), "c": ([90.0, 200.0], 2), None: ([5.0], 2)}


def test_pages_borrow_the_document_s_gaps(spark):
    two = [(50.0, 265.0), (285.0, 500.0)]
    rows = [("d", p, *x) for p in (1, 2) for x in two * 6] + [("d", 3, *x) for x in [*two, (60.0, 300.0)]] + [("d", 4, 50.0, 500.0)] * 5 + [("e", 1, 50.0, 200.0)]
    lines = spark.createDataFrame(rows, "doc string, page int, x0 double, x1 double")
    every = {(r.doc, r.page): (r.gutters is not None, r.borrowed) for r in C.page_gutters(lines, "doc", "page").collect()}
    assert every.pop(("e", 1)) == (False, False)
    got = {page: x for (_, page), x in every.items()}
    assert got == {1: (True, False), 2: (True, False), 3: (True, True), 4: (False, False)}
    boxes = [(1, 10.0, 0.0, 400.0, 9.0, "head"), (1, 300.0, 10.0, 400.0, 19.0, "r1"), (1, 10.0, 11.0, 200.0, 20.0, "l1"), (1, 10.0, 30.0, 200.0, 39.0, "l2"), (1, 300.0, 30.0, 400.0, 39.0, "r2")]
    table = spark.createDataFrame(boxes, "page int, x0 double, y0 double, x1 double, y1 double, text string").selectExpr("*", "array(250.0D) AS gutters")
    assert [r.text for r in reading_order(table, ["page"], "gutters").orderBy("place").collect()] == ["head", "l1", "l2", "r1", "r2"]


def test_lines_meet_their_gaps_where_they_are(spark, pages):
    """Every line comes out once, with or without keys or a place, and lines are dealt by page once only."""
    rows = [(d, p, float(a), float(b), "x") for (d, p), lines in pages.items() for a, b in lines] + [("d", 102, None, 3.0, "x"), (None, None, 1.0, 2.0, "x")]
    table = spark.createDataFrame(rows, "doc string, page int, x0 double, x1 double, text string").repartition(5)
    told = C.with_gutters(table, "doc", "page")
    own = {(r.doc, r.page): r.gutters for r in C.gutters(table, ["doc", "page"]).collect()}
    out = told.collect()
    assert sorted(map(str, [(r.doc, r.page, r.x0, r.x1) for r in out])) == sorted(map(str, [r[:4] for r in rows]))
    assert all(r.gutters == own[r.doc, r.page] and not r.borrowed for r in out if (r.doc, r.page) in own)
    assert all((r.gutters is not None) == r.borrowed for r in out if (r.doc, r.page) not in own)
    pages_told = {(r.doc, r.page): (r.gutters, r.borrowed) for r in C.page_gutters(table, "doc", "page").collect()}
    assert all(pages_told[r.doc, r.page] == (r.gutters, r.borrowed) for r in out if r.x0 is not None)
    # lines are dealt once, and their pages' gaps to them
    plan = reading_order(told.selectExpr("*", "x0 AS y0"), C.KEY, "gutters")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 2
