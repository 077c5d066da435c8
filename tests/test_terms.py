"""Terms by character against one regular expression a term."""

import random
import re
import unicodedata

from docloom.operators import terms as T


def plain_find(text, terms):
    text = re.sub(r"\s+", " ", unicodedata.normalize("NFKC", text or "")).casefold().strip()
    covered, out = [], []
    for term in sorted({t for t in terms if t}, key=lambda t: (-len(t), t)):
        form = re.sub(r"\s+", " ", unicodedata.normalize("NFKC", term)).casefold().strip()
        if not form:
            continue
        shape = re.escape(form) if re.search("[가-힣]", form) else rf"(?<![a-z0-9]){re.escape(form)}(?:e?s)?(?![a-z0-9])"
        for m in re.finditer(shape, text):
            if all(m.end() <= a or m.start() >= b for a, b in covered):
                covered.append(m.span())
                out.append((*m.span(), term, m[0]))
    return sorted(out)


TERMS = ["Loan", "loan", "loan rate", "rate", "금리", "변동 금리", "box", "ＡＢ", "ab", "aa", "a", "c++", "rates fixed", "일일", "", None, "  ", "Straße", "x.y"]


def made():
    rng = random.Random(6)
    words = ["loan", "LOANS", "rate", "rates", "rated", "fixed", "금리는", "변동", "금리", "boxes", "box", "boxe", "ab", "Ａｂ", "aa", "aaa", "a", "as", "c++", "c++s", "일일일", "STRASSE", "x.y", "xay", ",", "1ab", "é"]
    return [(i % 7 if i % 5 else None, rng.choice([" ", "  ", "\n"]).join(rng.choices(words, k=rng.randint(0, 25)))) for i in range(200)] + [(3, None), (3, ""), (3, "loan"), (3, "loan")]


def test_places_equal_one_search_a_term(spark):
    rows = made()
    texts = spark.createDataFrame([(*r, "clash", 0) for r in rows], "id int, t string, term string, start int").repartition(4)
    terms = spark.createDataFrame([(t,) for t in [*TERMS, "loan"]], "term string")
    want = sorted(str((k, *x)) for k, t in rows for x in plain_find(t, TERMS))
    for limit in (T.LIMIT, 12):
        assert sorted(str(tuple(r)) for r in T.find_terms(texts, "id", "t", terms, limit=limit).collect()) == want
    assert len(want) > 300
    assert T.find_terms(texts, "id", "t", terms.limit(0)).count() == 0 and T.find_terms(texts.limit(0), "id", "t", terms).count() == 0


def test_groups(spark):
    texts = spark.createDataFrame([(1, "a loan and loans"), (None, "loan")], "id int, t string")
    found = T.find_terms(texts, "id", "t", spark.createDataFrame([("loan",)], "term string"))
    assert {(r.id, r.term, r.n, tuple(map(tuple, r.places))) for r in T.group_places(found, "id").collect()} == {(1, "loan", 2, ((2, 6), (11, 16))), (None, "loan", 1, ((0, 4),))}
