"""Headers that are alike, against all pairs of keys."""

import difflib
import math
import random
import re

import pytest

from docloom.operators import headers as H
from docloom.operators.layout import body_lines

SCHEMA = "doc string, page int, text string, key int, n int, letters string"


def alike(a, b):
    return a == b or difflib.SequenceMatcher(None, a, b).ratio() >= 0.6


@pytest.fixture(scope="module")
def lines():
    rng = random.Random(4)
    rows = []
    for doc in ("a", "b", "c", None):
        pages = {"a": 12, "b": 2, "c": 5, None: 9}[doc]
        for page in range(pages):
            rows.append((doc, page, f"Chapter {page} of the handbook {rng.choice(['', 'vol. I', 'vol. II'])}"))
            rows.append((doc, page, f"{rng.choice(['page', 'PAGE', 'pg'])} {page}"))
            rows += [(doc, page, "".join(rng.choices("abcdefgh ", k=rng.randint(0, 25)))) for _ in range(4)]
    rows += [("a", None, "Chapter 9 of the handbook"), ("a", 1, None), ("a", 2, ""), ("c", 3, "日本語の見出し １２"), ("c", 4, "日本語の見出し"), ("c", 1, "日本の見出し")]
    return [*rows, *rows[:5]]


def key_of(text):
    return re.sub(r"\d+", "#", re.sub(r"\s+", "", text))


def test_pairs_equal_all_pairs(spark, lines):
    keys = [(doc, key_of(t)) for doc, _, t in lines if t is not None]
    got = {tuple(r) for r in H.similar_pairs(spark.createDataFrame(keys, "doc string, key string"), "doc", "key").collect()}
    want = {(d, a, b) for d, a in keys for e, b in keys if d == e and a and b and alike(a, b)}
    assert got == want and len(want) > 150


def test_headers_equal_a_plain_count(spark, lines):
    table = spark.createDataFrame([(*r, 1, 2, "clash") for r in lines], SCHEMA).repartition(4)
    got = {(r.doc, r.key): r.pages for r in H.running_headers(table, "doc", "page", "text").collect()}
    want = {}
    for doc in {r[0] for r in lines}:
        pages = {}
        for d, page, text in lines:
            if d == doc:
                pages.setdefault(page, set()).update({key_of(text)} - {""} if text is not None and len(key_of(text)) > 1 else ())
        need = max(3, math.ceil(len(pages) * 0.25))
        for key in set().union(*pages.values()):
            n = sum(any(alike(key, other) for other in keys) for keys in pages.values())
            if len(pages) >= 3 and n >= need:
                want[doc, key] = n
    assert got == want and {d for d, _ in want} == {"a", "c", None}
    assert H.running_headers(table.limit(0), "doc", "page", "text").count() == 0


def test_forms_and_body(spark):
    rows = [("d", p, 0.0, 10.0, 1000.0, f"Report {p} - {'draft' if p % 2 else 'drafts'}") for p in range(5)]
    rows += [("d", p, 500.0, 510.0, 1000.0, "Report 1 - draft") for p in range(5)] + [("d", p, 980.0, 990.0, 1000.0, f"- {p} -") for p in range(5)] + [("d", 1, 2.0, 4.0, 1000.0, "only here"), ("d", 2, None, None, None, "Report 7 - draft")]
    table = spark.createDataFrame(rows, "doc string, page int, y0 double, y1 double, height double, text string")
    found = H.running_headers(table.where("y0 = 0"), "doc", "page", "text")
    forms = {r.key: r.form for r in H.header_forms(found, "doc").collect()}
    assert set(forms) == {"Report#-draft", "Report#-drafts"} and len(set(forms.values())) == 1
    left = sorted(r.text for r in H.without_headers(table, "doc", "page", "text").collect())
    assert left == sorted(["Report 1 - draft"] * 5 + ["only here", "Report 7 - draft"])


def test_page_numbers_of_any_length(spark):
    rows = [("d", p, 980.0, 990.0, 1000.0, said) for p, said in enumerate(["- 7 -", "10000", "123456 / 2000000"])] + [("d", 1, 500.0, 510.0, 1000.0, "10000")]
    table = spark.createDataFrame(rows, "doc string, page int, y0 double, y1 double, height double, text string")
    assert [(r.y0, r.text) for r in H.without_headers(table, "doc", "page", "text").collect()] == [(500.0, "10000")]
    assert [(r.y0, r.text) for r in body_lines(table, "doc", "page", "text").collect()] == [(500.0, "10000")]


def test_texts_are_split_once(spark):
    from docloom.plans.headers import _lines

    plan = _lines(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
