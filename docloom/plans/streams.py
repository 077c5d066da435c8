"""Answers of conversations, written as items and as JSON, cut into short pieces and parsed piece by piece."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming.parsers import parse_pieces
from .registry import query
from .turns import TURN_PAIRS, turn_pairs

PIECE = 23


def _pieces(pairs: DataFrame, text: Column) -> DataFrame:
    n = F.ceil(F.length("whole") / PIECE).cast("int")
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col("whole"), i * PIECE + 1, F.lit(PIECE)))
    return pairs.withColumn("whole", text).select("pair", F.posexplode(cut).alias("seq", "piece"))


def _flat(text: str) -> Column:
    return F.trim(F.regexp_replace(text, "[\\s\\x0B]+", " "))


_FLAT = "trim(regexp_replace({0}, '[\\s\\x0B]+', ' ', 'g'))"


@query(f"""WITH {TURN_PAIRS} SELECT pair, pair AS evidence, {_FLAT.format('a')} AS question, {_FLAT.format('b')} AS answer FROM pairs""")
def streamed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The item of every pair of turns, read from its pieces."""
    whole = F.concat(F.lit("Items:\n<<<FAQ\n근거: "), "pair", F.lit("\n질문: "), _flat("a"), F.lit("\n답변: "), _flat("b"), F.lit("\n>>>\n"))
    events = parse_pieces(_pieces(turn_pairs(spark, sf_dir), whole), "pair", "seq", "piece").where("kind = 'item'")
    item = F.from_json("text", "evidence string, question string, answer string")
    return events.select(F.col("key").alias("pair"), item.alias("i")).select("pair", "i.*")


@query(f"""WITH {TURN_PAIRS} SELECT pair, 'asked' AS name, {_FLAT.format('a')} AS value FROM pairs UNION ALL SELECT pair, 'answered', {_FLAT.format('b')} FROM pairs UNION ALL SELECT pair, 'n', length(a)::VARCHAR FROM pairs""")
def streamed_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The updates of every pair of turns, read from the pieces of a JSON answer."""
    pairs = turn_pairs(spark, sf_dir)
    updates = F.to_json(F.struct(_flat("a").alias("asked"), _flat("b").alias("answered"), F.length("a").alias("n")))
    events = parse_pieces(_pieces(pairs, F.concat(F.lit('{"ok": true, "updates": '), updates, F.lit("}"))), "pair", "seq", "piece", "pairs")
    value = F.when(F.startswith("text", F.lit('"')), F.get_json_object(F.concat(F.lit('{"v":'), "text", F.lit("}")), "$.v")).otherwise(F.col("text"))
    return events.select(F.col("key").alias("pair"), "name", value.alias("value"))
