"""Every turn of a conversation is in a pair."""

from docloom.plans import QUERIES
from docloom.plans.turns import turn_pairs


def test_every_turn_is_paired(spark, tmp_path):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "a b c"), (1, 2, "assistant", "a b c"), (1, 3, "user", "d"), (1, 4, "user", "e"), (1, 5, "assistant", "f"), (1, 6, "assistant", "g"), (2, 0, "assistant", "h"), (2, 1, "user", None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    want = {"1/1": ("a b c", "a b c"), "1/3": ("d", ""), "1/4": ("e", "f"), "1/6": ("", "g"), "2/0": ("", "h"), "2/1": ("", "")}
    assert {r.pair: (r.a, r.b) for r in turn_pairs(spark, str(tmp_path)).collect()} == want
    used = {r.pair: (r.n_terms, r.applied) for r in QUERIES["dictionary_usage"](spark, str(tmp_path)).collect()}
    assert used == {"1/1": (3, 3), "1/3": (1, 0), "1/4": (1, 0), "1/6": (0, 0), "2/0": (0, 0), "2/1": (0, 0)}


def test_words_of_any_language_count(spark, tmp_path):
    spark.createDataFrame([(1, "moved house")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, "house", None), (2, "moved applied", "ko")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert QUERIES["glossary_compliance_all"](spark, str(tmp_path)).first().applied == 2
    assert {r.word for r in QUERIES["verb_stems_all"](spark, str(tmp_path)).collect()} == {"moved", "house", "applied"}


def test_whole_questions_are_compared(spark, tmp_path):
    rows = [(1, 0, "user", "the same long beginning, then one"), (1, 1, "assistant", "a"), (1, 2, "user", "the same long beginning, then two"), (1, 3, "assistant", "b"), (1, 4, "user", "The same long beginning - then two"), (1, 5, "assistant", "c")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert {r.pair: r.reason for r in QUERIES["turn_adopted_items"](spark, str(tmp_path)).collect()} == {"1/0": None, "1/2": None, "1/4": "duplicate"}
