"""Personal data, facts, directions, Markdown, changes and suites: inline queries against their SQL, and brute force."""

import html
import random
import re

import pytest
from pyspark.sql import functions as F

from docloom.operators import changes, markdown, pii, suites

from examples import EXAMPLES, PRIVATE



def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(EXAMPLES))
def test_examples_equal_their_sql(spark, name):
    import duckdb

    run, sql = EXAMPLES[name]
    out, want = run(spark, "/nowhere"), duckdb.sql(sql)
    assert sorted(out.columns) == sorted(want.columns)
    assert rows_of(out.columns, out.collect()) == rows_of(want.columns, want.fetchall())


def digits(token):
    return [int(c) for c in token if c.isdigit()]


def luhn(token):
    n = digits(token)[::-1]
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(n)) % 10 == 0


def plain_places(text):
    """What each pattern finds, kinds in order, overlaps with earlier finds left out."""
    out = []
    body = re.sub(r"(?i)</?mark\s*>", "", text or "")
    for kind, shape in pii.SHAPES.items():
        for m in re.finditer(shape, body):
            n, t = digits(m[0]), m[0]
            if kind == "rrn":
                good = 1 <= n[2] * 10 + n[3] <= 12 and 1 <= n[4] * 10 + n[5] <= 31 and (11 - sum(a * b for a, b in zip(n, [2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5], strict=False)) % 11) % 10 == n[12]
            elif kind == "biz":
                good = (10 - (sum(a * b for a, b in zip(n, [1, 3, 7, 1, 3, 7, 1, 3, 5], strict=False)) + n[8] * 5 // 10) % 10) % 10 == n[9]
            elif kind == "card":
                good = luhn(t)
            elif kind == "name":
                given = t[2:] if t[:2] in pii.FAMILY_2 and len(t) > 2 else t[1:]
                good = given not in pii.NO_GIVEN_NAME and t not in pii.TITLES and t + "님" not in pii.TITLES
            else:
                good = True
            if good and not any(m.start() < e and s < m.end() for _, s, e in out):
                out.append((kind, *m.span()))
    return sorted(out, key=lambda x: x[1:])


def test_personal_data_equals_brute_force(spark):
    rng = random.Random(4)
    parts = [t for _, t in PRIVATE if t] + ["4111-1111-1111-1111", "031 - 123 - 4567", "<mark>", "</mark>", "김서방 님", "홍길동 씨", "이것 님", "a@b.co", " ", "-", "1", "본문"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 6))) for _ in range(300)] + ["", None, "x " * 50_000 + "a@b.co"]
    rows = list(enumerate(texts))
    got = {}
    for r in pii.audit(spark.createDataFrame(rows, "k int, t string"), "k", "t").collect():
        got.setdefault(r.k, []).append((r.category, r.start, r.end))
    assert got == {k: p for k, t in rows if (p := plain_places(t))}
    assert pii.leaks(spark.createDataFrame([], "k int, t string"), "t").count() == 0


def test_changes_rebuild_the_text():
    """Words outside the changes are the same on both sides, in order."""
    rng = random.Random(6)
    vocab = ["alpha", "beta", "<b>", "gamma.", "delta!", "다.", "\n", "# head\n", "| a |\n"]
    for _ in range(300):
        a = " ".join(rng.choices(vocab, k=rng.randint(0, 25)))
        b = " ".join(w for x in a.split(" ") if rng.random() > 0.1 for w in ([x] if rng.random() > 0.1 else [x, "new"]))
        found = changes.changes(a, b)
        left, right = list(a), list(b)
        for c in found:
            for text, side in ((left, "source"), (right, "target")):
                if c[f"{side}_start"] is not None:
                    text[c[f"{side}_start"] : c[f"{side}_end"]] = " " * (c[f"{side}_end"] - c[f"{side}_start"])
            assert c["before"] or c["after"]
        assert "".join(left).split() == "".join(right).split()


def test_marks_never_cross(spark):
    rng, text = random.Random(3), "one two <b>three</b>\n```\ncode\n```\nfour five six"
    rows = [(i, [tuple(sorted((rng.randint(-2, 50), rng.randint(-2, 50)))) for _ in range(rng.randint(0, 6))]) for i in range(100)]
    df = spark.createDataFrame(rows, "i int, s array<struct<start:int,end:int>>")
    for r in df.select("s", markdown.highlight(F.lit(text), F.col("s")).alias("h")).collect():
        assert r.h.replace("<mark>", "").replace("</mark>", "") == text
        assert re.fullmatch(r"(?:(?!</?mark>).)*(?:<mark>(?:(?!</?mark>).)+</mark>(?:(?!</?mark>).)*)*", r.h, re.S)
        assert "<mark>" not in r.h[r.h.index("```") : r.h.rindex("```")]


def test_markdown_round_trip_of_odd_texts(spark):
    rng = random.Random(9)
    parts = ["# h", "```", "~~~", "| a | b |", "|---|---|", "- x", "> q", "<table>", "</table>", "<td>c & d</td>", "\r", "\n", "\n", " ", "t x", "\\|", "<!-- c -->", "1) y", " z "]
    rows = [(i, "".join(rng.choices(parts, k=rng.randint(1, 30)))) for i in range(300)] + [(900, ""), (901, None)]
    df = spark.createDataFrame(rows, "k int, t string")
    cut = markdown.split_units(df, "k", "t")
    none = cut.select("k", "unit", F.lit(None).cast("string").alias("translated")).where("false")
    got = {r.k: r.text for r in markdown.rebuild(cut, none, "k").collect()}
    assert {k: v for k, v in got.items() if v} == {k: t if "<table>" not in t else got[k] for k, t in rows if t}
    tables = [t for _, t in rows if t and "<table>" in t]
    assert tables and all(html.unescape(got[k]) == html.unescape(t) for k, t in rows if t)


def test_suite_verdicts(spark):
    wanted = suites.targets(spark)
    good = {"yield_rate": 0.9, "rejection_rates.schema": 0.0}
    rows = [(f"r{i}", "faq", f"faq_generation_health.{k}", v) for i in range(3) for k, v in good.items()]
    rows += [("r0", "faq", "pii_leak_count.leak_count", 0.0), ("r1", "faq", "pii_leak_count.leak_count", 2.0), ("r3", "faq", "pii_leak_count.leak_count", None)]
    checks = suites.check_targets(spark.createDataFrame(rows, "run string, feature string, path string, actual double"), wanted)
    assert {r.run: r.verdict for r in suites.verdicts(checks).collect()} == {"r0": "pass", "r1": "fail", "r2": "pass_but_incomplete", "r3": "not_measured"}


def test_units_and_likeness_of_changes():
    cut = lambda t: [t[a:b] for a, b in changes.units(t)]
    assert cut("一。 二. 갔다.왔다. 해요.그래 끝") == ["一。", "二.", "갔다.왔다.", "해요.그래 끝"]
    assert changes._alike("ab", "ba") == 1.0 and changes._alike("", " ") == 1.0 and changes._alike("ab", "") == 0 and changes._alike("abcd", "abce") == 1 / 3


def test_names_are_looked_for_where_words_begin():
    """The shape finds what a plain list of names finds, and tests one range where no Hangul word begins."""
    plain = f"(?<![가-힣])(?:{'|'.join([*pii.FAMILY_2, *pii.FAMILY_1])})[가-힣]{{1,2}}(?= ?(?:{'|'.join(pii.TITLES)}))"
    rng = random.Random(5)
    parts = [*pii.FAMILY_2, *pii.FAMILY_1, *pii.TITLES, " ", " ", " ", "\n", "a", "민준", "독", "궁", "1"]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 12))) for _ in range(4000)] + ["독고민준 님", "독민준 님", "남궁 씨", "남궁민씨", "황보김님", "사공명수 대리"]
    places = lambda shape: [[m.span() for m in re.finditer(shape, t)] for t in texts]
    assert places(pii.SHAPES["name"]) == places(plain) and sum(map(len, places(plain))) > 500
    assert pii.SHAPES["name"].startswith("[가-힣]")
