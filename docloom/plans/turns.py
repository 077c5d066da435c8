"""The pair queries over every turn of a conversation, keyed by conv_id and turn as 'conv_id/turn'."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import documents  # noqa: F401  registers the SQL of its pair queries
from .queries import PAIRS
from .registry import BASES, query, table


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn (a) with the assistant turn right after it (b); a turn of either without partner has the empty text there."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    t = t.withColumns({"_next": F.lead("role").over(w), "_answer": F.lead("text").over(w), "_last": F.lag("role").over(w)})
    asked = F.col("role") == "user"
    alone = (F.col("role") == "assistant") & ~F.col("_last").eqNullSafe("user")
    answer = F.when(alone, F.col("text")).when(F.col("_next") == "assistant", F.col("_answer")).otherwise("")
    pair = F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return t.where(asked | alone).select(pair.alias("pair"), F.when(asked, F.col("text")).otherwise("").alias("a"), answer.alias("b"))


TURN_PAIRS = """turned AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, lead(role) OVER w AS next, lead(coalesce(text, '')) OVER w AS answer, lag(role) OVER w AS last
    FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
  pairs AS (SELECT concat_ws('/', conv_id::VARCHAR, turn::VARCHAR) AS pair, CASE WHEN role = 'user' THEN text ELSE '' END AS a,
    CASE WHEN role = 'assistant' THEN text WHEN next = 'assistant' THEN answer ELSE '' END AS b
  FROM turned WHERE role = 'user' OR (role = 'assistant' AND last IS DISTINCT FROM 'user'))"""


def _over_turns(name: str) -> str:
    """The SQL of a query over first pairs, over all pairs."""
    before, after = BASES[name].split(PAIRS)
    return (before + "\0" + after).replace("conv_id", "pair").replace("\0", TURN_PAIRS)


@query(_over_turns("pair_similarity"))
def turn_pair_similarity(spark, sf_dir):
    from ..operators.scores import pair_similarity

    return pair_similarity(turn_pairs(spark, sf_dir), "pair", "a", "b")


@query(_over_turns("chrf"))
def turn_chrf(spark, sf_dir):
    from ..operators.scores import chrf

    return chrf(turn_pairs(spark, sf_dir), "pair", "a", "b")


@query(_over_turns("multiset_diff"))
def turn_multiset_diff(spark, sf_dir):
    from ..operators.scores import multiset_diff

    p = turn_pairs(spark, sf_dir)
    side = lambda c: p.select("pair", F.explode(F.split(c, " ")).alias("word"))
    return multiset_diff(side("a"), side("b"), "pair", "word")


@query(_over_turns("evidence_ratio"))
def turn_evidence_ratio(spark, sf_dir):
    from ..operators.guards import evidence_ratio

    return turn_pairs(spark, sf_dir).select("pair", evidence_ratio(F.col("b"), F.col("a")).alias("ratio"))


@query(_over_turns("grounding"))
def turn_grounding(spark, sf_dir):
    from ..operators.guards import grounding

    return grounding(turn_pairs(spark, sf_dir), "pair", "b", "a")


@query(_over_turns("value_verdicts"))
def turn_value_verdicts(spark, sf_dir):
    from ..operators.guards import value_verdict

    return turn_pairs(spark, sf_dir).select("pair", value_verdict(F.col("a"), F.col("b")).alias("verdict"))


@query(_over_turns("fallback_rate"))
def turn_fallback_rate(spark, sf_dir):
    from ..operators.guards import fallback_rate

    lines = lambda c: F.size(F.split(c, "\n"))
    return fallback_rate(turn_pairs(spark, sf_dir).select(lines("a").alias("i"), lines("b").alias("o"), (F.col("b") == "").alias("f")), "i", "o", "f")


@query(f"""WITH {TURN_PAIRS}, t AS (SELECT pair, split_part(pair, '/', 1) AS conv, split_part(pair, '/', 2)::BIGINT AS turn, trim(a) AS a, trim(b) AS b, length(b) % 3 > 0 AS ok, regexp_replace(lower(a), '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS q FROM pairs),
  f AS (SELECT *, min(turn) FILTER (ok AND q <> '' AND a <> '' AND b <> '') OVER (PARTITION BY conv, q) AS first FROM t)
  SELECT pair, CASE WHEN a = '' OR b = '' THEN 'schema' WHEN q = '' OR turn > first THEN 'duplicate' WHEN NOT ok THEN 'ungrounded' END AS reason FROM f""")
def turn_adopted_items(spark, sf_dir):
    """Whole user turns as questions, the assistant's as answers; duplicates are found within a conversation."""
    from ..operators.guards import adopt

    part = lambda i: F.split_part("pair", F.lit("/"), F.lit(i))
    t = turn_pairs(spark, sf_dir).select("pair", part(1).alias("conv"), part(2).cast("long").alias("turn"), F.col("a").alias("question"), F.col("b").alias("answer"), F.col("b").alias("evidence"))
    return adopt(t.withColumn("ok", F.length("answer") % 3 > 0), "conv", "turn", "ok").select("pair", "reason")


@query(BASES["verb_stems"].replace(" WHERE lang = 'en'", ""))
def verb_stems_all(spark, sf_dir):
    """``verb_stems`` over documents of any language or none."""
    from ..functions.language import verb_stems

    words = lambda t: table(spark, sf_dir, t).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    return words("benchmark").unionByName(words("documents")).distinct().select("word", F.array_join(verb_stems(F.col("word")), " ").alias("stems"))


@query(BASES["glossary_compliance"].replace(" WHERE lang = 'en'", ""))
def glossary_compliance_all(spark, sf_dir):
    """``glossary_compliance`` against documents of any language or none."""
    words = lambda t, *key: table(spark, sf_dir, t).select(*key, F.explode(F.split(F.lower("text"), " ")).alias("w")).distinct()
    n, hit = F.count(F.lit(1)), F.count("hit")
    met = words("benchmark", "item_id").join(words("documents").withColumn("hit", F.lit(1)), "w", "left")
    return met.groupBy("item_id").agg(n.alias("n_terms"), hit.alias("applied"), F.coalesce(F.round(hit / F.nullif(n, F.lit(0)), 4), F.lit(1.0)).alias("compliance"))
