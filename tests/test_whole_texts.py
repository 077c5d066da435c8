"""Queries read whole texts."""

import time

from pyspark.sql import functions as F

from docloom.functions import language as L
from docloom.operators import ordered


def test_languages_of_whole_texts(spark):
    row = spark.createDataFrame([("word " * 1000 + "한글 " * 4000,)], "x string")
    got = row.select(L.detect(F.col("x")).alias("d"), L.detect(F.col("x"), 4000).alias("h")).first()
    assert (got.d.code, got.d.share) == ("ko", 0.6667) and got.h.code == "en"


def test_null_texts_are_a_group(spark):
    rows = spark.createDataFrame([(1, None), (2, "a"), (3, None), (4, "")], "id long, x string")
    assert sorted(map(tuple, ordered.first_of_equal(rows, "id", "x").collect())) == [(1, 1, 2), (2, 2, 1), (3, 1, 2), (4, 4, 1)]


def test_letters_and_grams_of_long_texts(spark):
    from docloom.functions.language import VIETNAMESE, detect
    from docloom.functions.text import char_ngram_sizes, char_ngrams

    assert all("\u00c0" <= c <= "\u024f" or "\u1e00" <= c <= "\u1eff" for c in VIETNAMESE)
    texts = ["x" * 500_000 + "ệ", "é" * 200_000 + "가" * 3, "𝒳𝒴 𝒳𝒴𝒳", "", None, "ab", "Жж a 漢"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", "t", detect(F.col("t")).alias("d"), char_ngram_sizes(F.col("t")).alias("g"), char_ngrams(F.col("t")).alias("all"))
    began = time.monotonic()
    got = {r.i: r for r in rows.drop("all").collect()}
    assert [got[i].d.code for i in range(7)] == ["vi", "vi", "", "", "", "en", "ru"] and got[0].d.share == 1.0
    assert all(got[i].g == (len(r), len(set(r))) for i, r in ((r.i, r["all"]) for r in rows.where("i > 2").collect()))
    assert tuple(got[2].g) == (3, 2) and tuple(got[0].g) == (499_999, 2)
    assert time.monotonic() - began < 60
