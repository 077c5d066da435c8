"""Document operators against plain Python, worked examples and round trips; nulls, empty tables and ties in each."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from docloom.functions import collections as C
from docloom.functions import language as L
from docloom.operators import chunking, glossary, guards, layout, outline, revisions
from docloom.operators.ordered import scan


def value(spark, column, **row):
    return spark.createDataFrame([Row(**row)]).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("text", "code"),
    [("이번 달 ARR, NPS, CRM 수치를 모아 위원회에 알렸습니다", "ko"), ("plain words", "en"), ("xin chào bạn", "vi"), ("привет", "ru"), ("你好", "zh"), ("สวัสดี", "th"), ("12 34", ""), ("ab 가나", "en"), ("가나 ab", "ko")],
)
def test_detect(spark, text, code):
    assert value(spark, L.detect(F.col("x")), x=text).code == code


def test_word_forms(spark):
    assert value(spark, L.strip_particle(F.col("x")), x="가맹점으로는") == "가맹점"
    assert value(spark, L.strip_particle(F.col("x")), x="추가") == "추가"
    assert value(spark, L.strip_ending(F.col("x")), x="연체되었습니다") == "연체"
    assert value(spark, L.strip_ending(F.col("x")), x="대출한도") == "대출한도"
    for word, stems in [("refinanced", ["refinanc", "refinance"]), ("transferred", ["transferr", "transferre", "transfer"]), ("applied", ["apply"]), ("bed", [])]:
        assert value(spark, L.verb_stems(F.col("x")), x=word) == stems


@pytest.mark.parametrize(("word", "used", "expected"), [("서울으로", "으로", "로"), ("회사을", "을", "를"), ("집이", "이", "이"), ("학교가.", "가", "가")])
def test_particles(spark, word, used, expected):
    got = value(spark, L.particle_check(F.col("x")), x=word)
    assert (got.used, got.expected) == (used, expected)


def test_particle_errors_need_nouns(spark):
    texts = spark.createDataFrame([(1, "서울으로 회사을 증가 평가."), (2, None)], "id int, t string")
    nouns = spark.createDataFrame([("서울",), ("회사",)], "n string")
    assert [tuple(r) for r in guards.particle_errors(texts, "id", "t", nouns, "n").collect()] == [(1, 2, 2)]
    assert guards.particle_errors(texts, "id", "t", nouns.where("false"), "n").count() == 0


def found(spark, text, terms):
    texts = spark.createDataFrame([(1, text)], "id int, t string")
    rows = spark.createDataFrame([(t,) for t in terms], "term string")
    return sorted((r.start, r.n, r.term) for r in glossary.match_terms(texts, "id", "t", rows).collect())


def test_terms(spark):
    assert found(spark, "a mortgage, loan", ["mortgage loan"]) == []
    assert found(spark, "two mortgage loans here", ["mortgage loan", "mortgage", "loan"]) == [(1, 2, "mortgage loan")]
    assert found(spark, "a 401(k) and 401k", ["401(k)"]) == [(1, 4, "401(k)"), (6, 2, "401(k)")]
    assert found(spark, "가맹점을 제3자에게", ["가맹점", "제3자"]) == [(0, 1, "가맹점"), (1, 3, "제3자")]
    assert found(spark, "refinanced", ["Refinance", "refinance"]) == [(0, 1, "Refinance"), (0, 1, "refinance")]
    assert found(spark, None, ["x", None]) == []
    assert found(spark, "one two three four five six seven", ["one two three four five six seven"]) == [(0, 7, "one two three four five six seven")]


def test_terms_equal_plain_search(spark):
    rng = random.Random(3)
    vocab = ["ab", "cd", "ef", "gh"]
    rows = [(i, " ".join(rng.choices(vocab, k=rng.randint(0, 40)))) for i in range(30)]
    terms = [" ".join(rng.choices(vocab, k=k)) for k in (1, 2, 2, 3, 3, 4)]
    want = []
    for i, t in rows:
        w, at = t.split(), 0
        while at < len(w):
            hits = {x for x in terms if w[at : at + len(x.split())] == x.split()}
            size = max((len(x.split()) for x in hits), default=0)
            want += [(i, at, size, x) for x in sorted(hits) if len(x.split()) == size]
            at += size or 1
    got = glossary.match_terms(spark.createDataFrame(rows, "id int, t string"), "id", "t", spark.createDataFrame([(t,) for t in terms], "term string")).collect()
    assert sorted((r.id, r.start, r.n, r.term) for r in got) == sorted(want)
    # rows of one key or of none are matched each, by one automaton or by several
    again = spark.createDataFrame([(None if i % 3 == 0 else 7, t, "clash") for i, t in rows], "id int, t string, row string")
    keyed = sorted(str((None if i % 3 == 0 else 7, a, n, x)) for i, a, n, x in want)
    for limit in (glossary.LIMIT, 3):
        got = glossary.match_terms(again.repartition(3), "id", "t", spark.createDataFrame([(t,) for t in terms], "term string"), limit=limit).collect()
        assert sorted(str(tuple(r)) for r in got) == keyed
    assert glossary.match_terms(again.limit(0), "id", "t", spark.createDataFrame([("ab",)], "term string")).count() == 0
    assert glossary.match_terms(again, "id", "t", spark.createDataFrame([], "term string")).count() == 0


def test_texts_are_read_once_however_many_terms(spark):
    """Beyond the limit a block of texts meets its own terms; the texts are not read again for each part of the dictionary."""
    rows = [(1, "ab cd ab"), (2, "cd. ef"), (2, None), (None, "Abs gh")]
    texts = spark.createDataFrame(rows, "id int, t string")
    terms = spark.createDataFrame([(t,) for t in ("ab", "cd", "ab cd", "ef", "zz", "zz ab", "cd ef", "AB")], "term string")
    many, few = glossary.match_terms(texts, "id", "t", terms, limit=1), glossary.match_terms(texts, "id", "t", terms)
    assert many._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert sorted(map(str, many.collect())) == sorted(map(str, few.collect()))
    for limit in (1, glossary.LIMIT):
        once = glossary.match_terms(texts, "id", "t", terms, limit=limit, once=True).collect()
        assert sorted(map(str, once)) == sorted({str(r) for r in few.select("id", "term").collect()})


def test_matching_holds_no_more_for_more_text(monkeypatch):
    """What an automaton keeps is bounded by its dictionary and by ``KNOWN``, not by the words of the texts; matches go on before a text is through."""
    terms = [("ab", [("ab", False, False)]), ("ab, cd", [("ab", False, False), (",", False, True), ("cd", False, False)])]
    words = [(w, w, False) for w in ("ab", "cd")]
    other = ["".join(chr(ord("q") + int(d)) for d in str(i)) for i in range(3000)]
    text = [w for x in other for w in ("ab", x, "ab", "，", "cd", "cd", x)]
    want = [x for i in range(3000) for x in ((7 * i, 1, ["ab"]), (7 * i + 2, 3, ["ab, cd"]))]
    automaton = glossary.Automaton(terms, words)
    assert list(automaton.matches(text)) == want
    assert len(automaton.known) <= 5
    monkeypatch.setattr(glossary, "KNOWN", 1)
    automaton = glossary.Automaton(terms, words)
    assert list(automaton.matches(text)) == want
    assert len(automaton.known) == 1
    monkeypatch.setattr(glossary, "FOUND", 100)
    batches = list(glossary._found(pa.array([5, None]), [(0, automaton, " ".join(text)), (1, automaton, "ab"), (1, automaton, None)], False))
    assert max(b.num_rows for b in batches) <= 101
    got = [tuple(r.values()) for b in batches for r in b.to_pylist()]
    assert got == [(5, start, n, term) for start, n, (term,) in want] + [(None, 0, 1, "ab")]


TEXT = "# A\none two\n\n```\ncode | x\n\nmore\n```\n| a | b |\n| - | - |\n<table>\n<tr><td>x\n</td></tr></table>\nlast line here  \n\n"


@pytest.mark.parametrize("budget", [1, 7, 20, 60, 1000])
def test_chunks_lose_nothing(budget):
    for text in (TEXT, TEXT * 3, "", "\n\n", "x" * 50, "a\r\nb"):
        assert "".join(a + b for a, b in chunking.lossless_chunks(text, budget)) == text
        lines = chunking.line_chunks(text, budget)
        assert all(len(x) <= budget for x in lines)
        assert re.sub(r"\s", "", "".join(lines)) == re.sub(r"\s", "", text)
    assert any("code | x\n\nmore" in a for a, _ in chunking.lossless_chunks(TEXT, 10))


def test_headings_start_chunks():
    text = "\n".join(["x" * 10] * 7 + ["# New"] + ["y" * 10])
    assert chunking.line_chunks(text, 110)[1].startswith("# New")


def test_rebuild(spark):
    docs = spark.createDataFrame([(1, TEXT), (2, ""), (3, None)], "id int, t string")
    cut = chunking.split_lossless(docs, "id", "t", 20).cache()
    results = cut.where("i = 0").select("id", "i", F.lit("NEW").alias("result"))
    assert chunking.rebuild(cut, results.where("false"), "id").collect() == [Row(id=1, text=TEXT)]
    assert chunking.rebuild(cut, results, "id").first().text.startswith("NEW\n")


def test_blocks(spark):
    rows = [(1, 0, 0, "paragraph", "First sentence here. " * 8), (1, 1, 0, "table", "<table/>"), (1, 2, 0, "paragraph", "After."), (1, 3, 1, "paragraph", "Next section."), (1, 4, 1, "paragraph", None), (2, 0, 0, "paragraph", None)]
    blocks = spark.createDataFrame(rows, "d int, o int, section int, kind string, text string")
    got = [(r.section, r.kind, r.text) for r in sorted(chunking.chunk_blocks(blocks, "d", "o", 100, 30, 5).collect(), key=lambda r: (r.d, r.i))]
    assert [g[1] for g in got] == ["paragraph", "paragraph", "table", "paragraph", "paragraph"]
    assert got[-1] == (1, "paragraph", "Next section.") and all(len(g[2]) <= 100 for g in got)
    assert chunking.chunk_blocks(blocks.where("false"), "d", "o").count() == 0


def test_batches(spark):
    rng = random.Random(2)
    rows = [(k, i, "x" * rng.randint(0, 9)) for k in range(3) for i in range(40)] + [(9, 0, None)]
    got = chunking.pack_batches(spark.createDataFrame(rows, "k int, i int, t string"), "k", "i", "t", 20, 4).collect()
    want = set()
    for k in range(3):
        batch = size = n = 0
        for _, i, t in sorted(r for r in rows if r[0] == k):
            if n and (size + len(t) > 20 or n >= 4):
                batch, size, n = batch + 1, 0, 0
            size, n = size + len(t), n + 1
            want.add((k, i, batch))
    assert {tuple(r) for r in got} == want | {(9, 0, 0)}


def test_scan_keeps_keys_apart(spark):
    rows = spark.createDataFrame([(k, i) for k in (None, 1, 2) for i in range(5)], "k int, i int")
    got = scan(rows, ["k"], ["i"], "s", "int", lambda: 0, lambda s, i: (s + i, s + i), ["i"]).collect()
    assert sorted(r.s for r in got) == sorted([0, 1, 3, 6, 10] * 3)


def test_tables():
    html = "<table><tr><th>h</th></tr>" + "".join(f"<tr><td>{i:04}</td></tr>" for i in range(20)) + "</table>"
    parts = chunking.table_rows(html, 120)
    assert all(p.startswith("<table><tr><th>h</th></tr>") and len(p) <= 120 for p in parts)
    assert re.findall(r"\d{4}", "".join(parts)) == [f"{i:04}" for i in range(20)]


@pytest.mark.parametrize(
    ("text", "level", "label"),
    [("제2장 총칙", 2, "제2장 총칙"), ("제5조(목적) 이 규칙은 " + "가" * 40, 5, "제5조(목적)"), ("제5조에 따라", 0, None), ("부칙", 2, "부칙"), ("① 항", 6, "① 항"), ("2026. 8. 13.", 0, None), ("가. 목", 8, "가. 목"), (None, 0, None)],
)
def test_statute(spark, text, level, label):
    t = spark.createDataFrame([(text,)], "x string").select(outline.level_of(F.col("x")).alias("l"), outline.label_of(F.col("x")).alias("b")).first()
    assert (t.l, t.b) == (level, label)


def test_office_outline(spark):
    rows = [(1, i, t) for i, t in enumerate(["1. 개요", "가. 배경", "나. 목적", "2. 내용", "3) 하나", "4) 둘", "1.5배", "5. 이것은 문장이다."])]
    blocks = spark.createDataFrame([*rows, (2, 0, None)], "d int, o int, text string")
    got = {r.o: (r.level, r.label) for r in outline.office_outline(blocks, "d", "o").where("d = 1").collect()}
    assert got[0] == (2, "1. 개요") and got[1] == (3, "가. 배경") and got[4] == (0, None) and got[6] == (0, None) and got[7] == (0, None)


def test_addenda(spark):
    a = spark.createDataFrame([(1, 0, None, "2020-02-01"), (1, 1, None, "2022-03-01"), (1, 2, None, "2022-04-01"), (2, 0, None, "2020-01-01")], "k int, i int, date string, effective string")
    r = spark.createDataFrame([(1, "2020-01-01"), (1, "2022-01-01")], "k int, date string")
    got = sorted((x.k, x.i, x.revision) for x in revisions.pair_addenda(a, r, "k").collect())
    assert got == [(1, 0, "2020-01-01"), (1, 1, "2022-01-01"), (1, 2, None), (2, 0, None)]


def test_bare_headings(spark):
    rows = [(1, 0, "A", ["A"]), (1, 1, "x", ["A", "B"]), (1, 2, "C", ["C"]), (1, 3, "y", ["D"])]
    chunks = spark.createDataFrame(rows, "d int, o int, text string, path array<string>")
    assert sorted(r.o for r in outline.drop_bare_headings(chunks, "d", "o", "text", "path").collect()) == [1, 2, 3]


def test_page_reading(spark):
    def line(x, y, text, w=90):
        return ("p", float(x), float(y), float(x + w), float(y + 10), text)

    boxes = [line(0, 0, "Title across the page.", 200), line(0, 20, "left one exam-"), line(0, 32, "ple goes on"), line(110, 20, "right one ends."), line(110, 32, "- item"), line(45, 61, "in.", 45), line(0, 60, "new", 40)]
    df = spark.createDataFrame(boxes, "p string, x0 double, y0 double, x1 double, y1 double, text string")
    lines = layout.merge_rows(layout.box_rows(df, ["p"]), ["p"]).withColumn("gutter", F.lit(100.0))
    got = sorted(layout.paragraphs(layout.reading_order(lines, ["p"], "gutter"), ["p"]).collect(), key=lambda r: r.paragraph)
    assert [r.text for r in got] == ["Title across the page.", "left one example goes on", "new in.", "right one ends.", "- item"]


def test_running_lines(spark):
    rows = [("d", p, y, y + 10.0, 1000.0, t) for p in range(4) for y, t in ((10.0, f"Report {p}"), (500.0, "Report 9"), (985.0, f"- {p} -"), (600.0, f"body {p}"))]
    df = spark.createDataFrame(rows, "d string, p int, y0 double, y1 double, height double, text string")
    assert sorted(r.text for r in layout.body_lines(df, "d", "p", "text").collect()) == sorted(["Report 9"] * 4 + [f"body {p}" for p in range(4)])


def test_tone_and_endings(spark):
    good, bad = "확인했습니다. 안내드립니다. 처리합니다. 끝입니다.", "매우 좋습니다. 빨리 하라. 봅니다. 갑니다."
    df = spark.createDataFrame([(1, good, "clear", None), (2, bad, "polite", "debt_reason"), (3, good, "none", None)], "id int, t string, tone string, kind string")
    got = {r.id: r for r in guards.tone_check(df, "id", "t", "tone", "kind").collect()}
    assert (got[1].forbidden, got[2].applied, got[2].forced, got[3].ending_rate) == (0, "objective", True, None)
    assert got[2].forbidden == 1
    ends = spark.createDataFrame([(1, "합니다. 합니다. 해요. 해요."), (2, "합니다. 해요. 함."), (3, None)], "id int, t string")
    got = {r.id: (r.n, r.front, r.back, r.consistent) for r in guards.ending_consistency(ends, "id", "t").collect()}
    assert got == {1: (4, "hapnida", "haeyo", False), 2: (3, None, None, None), 3: (0, None, None, None)}


def test_adopt(spark):
    rows = [(1, 0, "Q?", "a", "e", False), (1, 1, "Q!", "a", "e", True), (1, 2, "q", "a", "e", True), (1, 3, None, "a", "e", True), (1, 4, "?", "a", "e", True)]
    df = spark.createDataFrame(rows, "d int, o int, question string, answer string, evidence string, ok boolean")
    assert {r.o: r.reason for r in guards.adopt(df, "d", "o", "ok").collect()} == {0: "ungrounded", 1: None, 2: "duplicate", 3: "schema", 4: "duplicate"}


def test_sessions_and_json(spark):
    a = value(spark, C.merge_blocks(F.col("b"), F.col("a"), F.array(F.lit(0)), 3), b=["x", "y", "z"], a=["n", "m"])
    assert (a.blocks, a.overflow) == (["y", "z", "n"], 1)
    assert value(spark, C.append_new(F.col("b"), F.lit("x"), 2), b=["x", "y", "z"]) == ["y", "z"]
    assert value(spark, C.json_object(F.col("x"), "a int"), x='```json\n{"a": 3}\n```').a == 3
    assert value(spark, C.json_array(F.col("x"), "int"), x="so: [1, 2] ok") == [1, 2]
    assert value(spark, C.entry_texts(F.col("x")), x=" a; b ;a;;") == ["a", "b"]
    assert value(spark, C.dig(F.col("x"), "a.b"), x='{"a": {"b": 1}}') == "1"
    assert value(spark, C.upgrade(F.lit(1), F.lit(None).cast("array<string>"), F.col("x")), x="h") == ["h"]


def test_tail_keeps_what_has_no_sentence_end():
    from docloom.operators.chunking import long_text, tail

    assert tail("abc def", 3) == "def" and tail("one. two", 5) == "two" and tail("ab", 5) == "ab"
    assert long_text("x" * 10, 4, 4)[0] == "xxxx"


def test_text_beside_a_table_stays():
    import xml.etree.ElementTree as ET

    from docloom.sources.documents import _block_text, _pieces

    root = ET.fromstring("<s><p><t>before</t><r><tbl><tr><tc><p><t>a</t></p></tc><tc><p><t>b</t></p></tc></tr></tbl></r><r><t>af</t><t>ter</t></r></p><p><t>next</t></p></s>")
    assert [_block_text(*x) for x in _pieces(root)] == [("paragraph", "before"), ("table", "a | b"), ("paragraph", "after"), ("paragraph", "next")]
