"""Operators on pairs and texts where keys are null or repeat, and arrays of thousands of items: each row stands for itself."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docloom.functions.collections import prefix
from docloom.operators import facts, markdown, pii, scores

PAIRS = [
    (None, "3 kg on 2020-01-02", "4 kg"), (1, "a 5", "a 5"), (1, "a 5", "a 6 6"), (1, None, None), (None, None, "7건"), (2, "", ""), (3, "Beta Corp 1,000", "Beta Corp 1000"), (None, "same text", "same text"),
]


def table(spark):
    return spark.createDataFrame([(*p, 0, "clash", 1) for p in PAIRS], "k int, a string, b string, _row int, kind string, n int").repartition(3)


def grams(t, n):
    t = "".join((t or "").split())
    return Counter([t] if 0 < len(t) < n else [t[i : i + n] for i in range(len(t) - n + 1)])


def test_facts_of_each_row(spark):
    got = Counter(tuple(r) for r in facts.cross_check(table(spark), "k", "a", "b").collect())
    want = Counter([
        (None, 2, 1, 0, 0, False), (1, 0, 0, 0, 0, True), (1, 3, 0, 0, 0, False), (1, 0, 0, 0, 0, True), (None, 1, 0, 1, 0, False), (2, 0, 0, 0, 0, True), (3, 0, 0, 0, 0, True), (None, 0, 0, 0, 0, True),
    ])
    assert got == want
    off = Counter(tuple(r) for r in facts.fact_differences(table(spark), "k", "a", "b").collect())
    assert off[1, "numbers", "5", 1, 0] == 1 and off[1, "numbers", "6", 0, 2] == 1 and off[None, "numbers", "3", 1, 0] == 1 and len(off) == 7
    texts = Counter(tuple(r) for r in facts.issue_texts(table(spark), "k", "a", "b").collect())
    assert texts == Counter([(None, "numbers", 2, "+4, -3"), (None, "dates", 1, "-2020-01-02"), (1, "numbers", 3, "+6, -5"), (None, "numbers", 1, "+7")])


def test_similarity_of_each_row(spark):
    def jaccard(a, b):
        x, y = grams(a, 3), grams(b, 3)
        return round(sum((x & y).values()) / sum((x | y).values()), 4) if x or y else 1.0

    def score(a, b):
        p, r = [], []
        for n in range(1, 7):
            if min(len("".join((t or "").split())) for t in (a, b)) >= n:
                x, y = grams(a, n), grams(b, n)
                p.append(sum((x & y).values()) / sum(x.values()))
                r.append(sum((x & y).values()) / sum(y.values()))
        p, r = (sum(v) / len(v) if v else 0 for v in (p, r))
        return round(5 * p * r / (4 * p + r), 4) if p + r else 0.0

    close = lambda rows: sorted(str((k, round(v, 3))) for k, v in rows)
    assert close(map(tuple, scores.pair_similarity(table(spark), "k", "a", "b").collect())) == close((k, jaccard(a, b)) for k, a, b in PAIRS)
    assert close(map(tuple, scores.chrf(table(spark), "k", "a", "b").collect())) == close((k, score(a, b)) for k, a, b in PAIRS)
    none = table(spark).limit(0)
    assert scores.pair_similarity(none, "k", "a", "b").count() == scores.chrf(none, "k", "a", "b").count() == facts.cross_check(none, "k", "a", "b").count() == 0


TEXTS = [(1, "# One\na b c"), (1, "d e f\n| x | y |"), (None, "g *h*"), (None, None), (2, ""), (None, "same"), (None, "same")]


def test_markdown_of_each_row(spark):
    docs = spark.createDataFrame([(*t, "clash", 5) for t in TEXTS], "k int, t string, row string, line int").repartition(3)
    cut = markdown.split_units(docs, "k", "t")
    none = spark.createDataFrame([], "k int, unit long, translated string")
    assert Counter(map(tuple, markdown.rebuild(cut, none, "k").collect())) == Counter((k, t or "") for k, t in TEXTS)
    given = spark.createDataFrame([(1, 0, "T|T"), (None, 0, "N"), (None, 0, "M"), (3, 0, "x")], "k int, unit long, translated string")
    got = Counter(map(tuple, markdown.rebuild(cut, given, "k").collect()))
    assert got == Counter([(1, "# T|T\na b c"), (1, "T|T\n| x | y |"), (None, "M"), (None, ""), (2, ""), (None, "M"), (None, "M")])
    assert Counter(r.k for r in markdown.structure(docs, "k", "t").collect()) == Counter(k for k, _ in TEXTS)
    pairs = spark.createDataFrame([(1, "# a", "# b"), (1, "# a", "## a"), (None, "| a |", None), (None, None, ""), (None, "x", "```")], "k int, a string, b string")
    got = Counter((r.k, tuple(r.issues), r.passed) for r in markdown.structure_issues(pairs, "k", "a", "b").collect())
    assert got == Counter([(1, (), True), (1, ("heading",), False), (None, ("markdown_table",), False), (None, (), True), (None, ("code_fence",), False)])


def test_markdown_is_cut_where_it_is_and_shuffled_once(spark):
    """Cutting moves nothing; of documents dealt by key neither segments nor translations move again, however partitions are put together."""
    rows = [(None if i % 50 == 0 else i // 2, f"# head {i}\ntext {i}\n" * (1 + i % 7)) for i in range(600)]
    docs = spark.createDataFrame(rows, "k int, t string")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert "Exchange" not in plan(markdown.split_units(docs, "k", "t")) and "Exchange" not in plan(markdown.lines(docs, "k", "t"))
    before = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.minPartitionSize")}
    try:
        for parts, size in (("64", "2000"), ("64", "64m"), ("4", "64m")):
            for c, v in zip(before, (parts, size, "1"), strict=True):
                spark.conf.set(c, v)
            cut = markdown.split_units(docs.repartition("k"), "k", "t")
            said = cut.where("kind = 'unit' AND unit % 3 = 1 AND k % 5 = 0").select("k", "unit", F.lit("new").alias("translated"))
            out = markdown.rebuild(cut, said, "k")
            assert plan(out).count("Exchange hashpartitioning") == 2 and "Exchange" not in plan(out).split("Union")[0]
            got = Counter(map(tuple, out.collect()))
            new = lambda k, t: "\n".join("# new" if x and i % 3 == 1 and i % 2 == 0 else "new" if x and i % 3 == 1 else x for i, x in enumerate(t.split("\n"))) if k is not None and k % 5 == 0 else t
            assert got == Counter((k, new(k, t)) for k, t in rows)
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


@pytest.mark.parametrize("n", [0, 1, 256, 257, 5000])
def test_prefixes(spark, n):
    rng = random.Random(n)
    values = [rng.randint(-50, 50) for _ in range(n)]
    row = spark.createDataFrame([(values,)], "v array<int>")
    sums, tops = row.select(prefix(F.col("v"), F.lit(0), lambda a, b: a + b), prefix(F.col("v"), F.lit(-99), lambda a, b: F.greatest(a, b))).first()
    assert sums == [sum(values[:i]) for i in range(n)] if n <= 257 else sums[-1] == sum(values[:-1]) and len(sums) == n
    assert tops == [max([-99, *values[:i]]) for i in range(n)] if n <= 257 else len(tops) == n


def test_spans_and_places_by_the_thousand(spark):
    rng = random.Random(8)
    for n in (0, 1, 7, 3000):
        spans = [(a, a + rng.randint(1, 6)) for a in (rng.randint(0, 4 * n) for _ in range(n))]
        want = []
        for a, b in sorted(spans):
            if want and a <= want[-1][1]:
                want[-1][1] = max(want[-1][1], b)
            else:
                want.append([a, b])
        got = spark.createDataFrame([(spans,)], "s array<struct<start:int,end:int>>").select(markdown.merge_spans(F.col("s"))).first()[0]
        assert [list(x) for x in got] == want
    text = "é a@b.co 1234 " * 6000
    found = spark.createDataFrame([(text,)], "t string").select(pii.personal_data(F.col("t"))["found"].alias("f")).first().f
    assert [(x.category, x.start, x.end) for x in found] == [("email", 14 * i + 2, 14 * i + 8) for i in range(6000)]


def test_grams_are_compared_within_rows(spark):
    from docloom.operators import scores

    pairs = spark.createDataFrame([(1, "abcabc", "abcab"), (1, "ab", "ab"), (None, None, "x"), (2, "a b", ""), (3, "", None), (4, "𝒳𝒴𝒳𝒴", "𝒳𝒴")], "k int, a string, b string")
    got = scores.pair_similarity(pairs, "k", "a", "b")
    assert sorted((r.k or 0, r.similarity) for r in got.collect()) == [(0, 0.0), (1, 0.75), (1, 1.0), (2, 0.0), (3, 1.0), (4, 0.0)]
    for out in (got, scores.chrf(pairs, "k", "a", "b")):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Aggregate" not in plan
