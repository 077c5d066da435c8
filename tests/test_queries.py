"""Every query that has SQL gives the SQL's rows; scalars give the values they are documented to give."""

import math

import duckdb
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from docloom.functions import numbers as N
from docloom.functions import text as T
from docloom.operators import ordered, scores
from docloom.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 4)
    return x


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, db, name):
    out = QUERIES[name](spark, SF)
    found = db.execute(ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(out.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in out.collect())
    assert got == sorted(repr([plain(x) for x in r]) for r in found.fetchall())


def value(spark, column, **row):
    return spark.createDataFrame([Row(**row)]).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("given", "want"),
    [("2026년 3월 12일", "2026-03-12"), ("2026-03-12", "2026-03-12"), ("2026.3.12", "2026-03-12"), ("2026년 3월", "2026-03"), ("3월 12일", "03-12")],
)
def test_canonical_date(spark, given, want):
    assert value(spark, N.canonical_date(F.col("x")), x=given) == want


def test_numbers(spark):
    assert value(spark, N.numbers(F.col("x")), x="2026-03-12 기준 1,250명, 3.5%") == [1250.0, 3.5]
    assert value(spark, N.number_fingerprint(F.col("x")), x="1,000 and 1.5") == ["1000", "15"]
    assert value(spark, N.number_fingerprint(F.col("x")), x="3 4 x 007") == ["34", "7"]


@pytest.mark.parametrize(
    ("check", "good", "bad"),
    [
        (N.valid_resident, "900101-1234568", "900101-1234567"),
        (N.valid_business, "123-45-67891", "123-45-67890"),
        (N.valid_card, "4111 1111 1111 1111", "4111 1111 1111 1112"),
    ],
)
def test_check_digits(spark, check, good, bad):
    assert value(spark, check(F.col("x")), x=good) is True
    assert value(spark, check(F.col("x")), x=bad) is False


def test_budget(spark):
    assert value(spark, N.chunk_budget(F.col("c"), F.col("n")), c=100000, n=5) == 20000
    assert value(spark, N.chunk_budget(F.col("c"), F.col("n")), c=1000, n=5) == 12000


def test_chrf(spark):
    pairs = spark.createDataFrame([(1, "the cat sat", "the cat sat"), (2, "the cat sat", "the cat sits"), (3, "", "x")], "id int, a string, b string")
    assert {r.id: r.chrf for r in scores.chrf(pairs, "id", "a", "b").collect()} == {1: 1.0, 2: 0.6103, 3: 0.0}


def test_spread(spark):
    ten = [(1, i, 1.0) for i in range(10)] + [(2, i, v) for i, v in enumerate([0.9, 1.0, 0.8, 0.9, 0.9, 0.9])]
    rows = spark.createDataFrame(ten, "k int, i int, v double")
    got = ordered.select_spread(rows, "k", "i", F.col("v"), 3).collect()
    assert sorted(r.i for r in got if r.k == 1) == [1, 5, 8]
    assert sorted(r.i for r in got if r.k == 2) == [1, 3, 5]


def test_last_five_saves(spark):
    rows = spark.createDataFrame([("s", f"t{i}", i) for i in range(7)], "s string, t string, i int")
    assert sorted(r.t for r in ordered.keep_last(rows, "s", "t", "i", 5).collect()) == ["t2", "t3", "t4", "t5", "t6"]


def test_page_fields(spark):
    rows = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (1, 2, 1)], "d int, o int, s int")
    got = sorted(ordered.page_fields(rows, "d", "o", "s").collect(), key=lambda r: r.o)
    assert [(r.i_page, r.i_chunk_on_page, r.n_chunk_of_page, r.n_page) for r in got] == [(1, 0, 2, 2), (1, 1, 2, 2), (2, 0, 1, 2)]


def test_grams(spark):
    assert value(spark, T.char_ngrams(F.col("x")), x="a bc d") == ["abc", "bcd"]
    assert value(spark, T.char_ngrams(F.col("x")), x="ab") == ["ab"]
    assert value(spark, T.char_ngrams(F.col("x")), x=" ") == []
    assert value(spark, T.word_ngrams(F.col("x")), x="One, two three!") == ["one two", "two three"]
