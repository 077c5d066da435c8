"""Packing against plain loops; nothing lost, budgets kept, titles that count their own parts."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docloom.operators import packing as P


def table(spark, rng):
    rows = []
    for doc in [*range(12), None]:
        for row in range(rng.randint(1, 5)):
            for cell in range(rng.randint(1, 4)):
                kind = rng.choice(["short", "short", "long", "line", "null"])
                text = {"short": "a" * rng.randint(0, 40), "null": None, "line": "x" * rng.randint(41, 400)}.get(kind) or (None if kind == "null" else "" if kind == "short" else " ".join(rng.choices(["One two. ", "three!\n", "é four", "five? "], k=rng.randint(8, 60))))
                rows.append((doc, row, cell, text, "clash"))
    return rows, spark.createDataFrame(rows, "doc int, row int, cell int, text string, piece string").repartition(4)


def plain_pieces(cells, limit):
    """{(piece, cell): text} of one row's (cell, text)."""
    cells = [(c, t or "") for c, t in cells]
    anchors, long = [x for x in cells if len(x[1]) <= 40], [x for x in cells if len(x[1]) > 40]
    total = sum(len(t) for _, t in cells)
    room = max(total, 1) if total <= limit or not long else max(limit - sum(len(t) for _, t in anchors), limit // 4)
    piece = used = 0
    out = {}
    for c, t in long:
        for s in re.findall(r"(?s).+?(?:\n|[.!?]\s+|\Z)", t):
            for part in (s[i : i + room] for i in range(0, len(s), room)):
                if used and used + len(part) > room:
                    piece, used = piece + 1, 0
                used += len(part)
                out[piece, c] = out.get((piece, c), "") + part
    return out | {(k, c): t for c, t in anchors for k in range(piece + 1)}


def test_wide_rows_equal_a_plain_loop(spark):
    rows, cells = table(spark, random.Random(5))
    pieces = P.split_wide_rows(cells, ["doc"], 120)
    got = {(r.doc, r.row, r.piece, r.cell): r.text for r in pieces.collect()}
    want = {}
    for key in {r[:2] for r in rows}:
        want |= {(*key, *k): t for k, t in plain_pieces([r[2:4] for r in rows if r[:2] == key], 120).items()}
    assert got == want and max(k[2] for k in got) > 3
    back = Counter((r.doc, r.row, r.cell, r.text) for r in P.whole_rows(pieces, ["doc"]).collect())
    assert back == Counter((*r[:3], r[3] or "") for r in rows)
    assert P.split_wide_rows(cells.limit(0), ["doc"], 120).count() == 0


@pytest.mark.parametrize("n", [1, 5, 40, 300])
def test_parts_know_how_many_they_are(spark, n):
    rng = random.Random(n)
    sizes = [rng.choice([5, 20, 30, 90, None, 200]) for _ in range(n)]
    rows = [(d, i, s, "Title", 10, "clash") for d in (1, None) for i, s in enumerate(sizes)]
    frame = spark.createDataFrame(rows, "doc int, i int, size int, title string, head int, parts string").drop("parts").repartition(3)
    got = sorted(P.table_parts(frame, ["doc"], ["i"], 120, head="head", title="title").where("doc = 1").collect(), key=lambda r: r.i)
    for digits in range(1, 8):
        room, part, used, want = 120 - 10 - 5 - len(" (표 /)") - 2 * digits, 1, 0, []
        for s in sizes:
            if used and used + (s or 0) > room:
                part, used = part + 1, 0
            used += s or 0
            want.append(part)
        if part < 10**digits:
            break
    assert [r.part for r in got] == want and {r.parts for r in got} == {part}
    assert {r.prefix for r in got} == ({f"Title (표 {k}/{part})" for k in range(1, part + 1)} if part > 1 else {"Title"})
    for k in range(1, part + 1):
        mine = [r.size or 0 for r in got if r.part == k]
        assert len([s for s in mine if s]) <= 1 or sum(mine) + 10 + len(f"Title (표 {k}/{part})") <= 120
    assert P.table_parts(frame, ["doc"], ["i"], 120).where("doc IS NULL").count() == n


def test_neighbours_merge_like_a_plain_loop(spark):
    rng = random.Random(2)
    rows = [(d, i, rng.choice([["A"], ["A", "B"], None, []]) if i % 3 == 0 else ["A"], rng.choice([None, "", "x" * rng.randint(1, 60)]), "clash") for d in [*range(9), None] for i in range(30)]
    got = sorted(P.merge_chunks(spark.createDataFrame(rows, "doc int, at int, path array<string>, text string, i string").repartition(3), "doc", "at", limit=100).collect(), key=lambda r: (r.doc is None, r.doc or 0, r.i))
    want = []
    for d in [*range(9), None]:
        held = []
        for _, _, path, text, _ in (r for r in rows if r[0] == d):
            text = text or ""
            if held and held[-1][0] == path and len(held[-1][1]) + 1 + len(text) <= 100:
                held[-1] = (path, held[-1][1] + "\n" + text, held[-1][2] + 1)
            else:
                held.append((path, text, 1))
        want += [(d, i, p, n, t) for i, (p, t, n) in enumerate(held)]
    assert [tuple(r) for r in got] == want
    assert all(len(r.text) <= 100 for r in got)


def test_a_key_of_many_chunks(spark):
    chunks = spark.range(20_000).select(F.lit(1).alias("doc"), F.col("id").alias("at"), F.array(F.lit("h")).alias("path"), F.lit("word").alias("text"))
    merged = P.merge_chunks(chunks, "doc", "at", limit=99)
    assert merged.agg(F.sum("n"), F.max("n")).first()[:] == (20_000, 20)
