"""Checks of generated text against its source: facts, evidence, grounding, tone, endings, and what is kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.language import particle_check
from ..functions.numbers import ratio
from ..functions.text import char_ngrams, evidence_form, nfkc, question_key, sentences, word_ngrams, words

# Sentence endings by class, and the rules of each tone.
ENDINGS = [("hapnida", "(?:습니다|합니다|십니다|입니다)$"), ("haeyo", "요$"), ("gaejosik", "[함임됨음짐옴]$"), ("da", "다$")]
TONES = {
    "polite": ("(?:습니다|합니다|입니다|십니다|됩니다)$", ["[가-힣](?:했다|한다|이다|없다|있다)(?=[\\s.]|$)", "(?:하라|해라|하시오|해야지)(?=[\\s.]|$)", "(?U)\\b(?:좀|되게|진짜|엄청|걍|넘)\\b"]),
    "friendly": ("(?:습니다|합니다|입니다|세요|어요|예요|에요)$", ["(?:하라|해라|하시오)(?=[\\s.]|$)", "요망|필히|하기와\\s*같이|동\\s*건|귀하께서는|승낙|기\\s*제출"]),
    "clear": ("(?:습니다|합니다|입니다|됩니다)$", ["에\\s*대하여|에\\s*대하여는|하는\\s*바입니다|에\\s*다름\\s*아닙니다", "(?U)\\b(?:매우|정말|아주|굉장히|무척|상당히)\\b", "(?:하라|해라|하시오)(?=[\\s.]|$)"]),
    "objective": ("(?:습니다|합니다|입니다|됩니다)$", ["(?:같습니다|듯합니다|생각합니다|느껴집니다|보입니다)(?=[\\s.]|$)", "(?U)\\b(?:아쉽게도|다행히|훌륭한|최고의|엄청난)\\b", "(?U)\\b(?:매우|정말|아주|굉장히|무척|상당히)\\b"]),
}
FORCED = {"debt_reason": "objective", "reviewer_opinion": "objective"}


def match_text(text: Column, expected: Column, mode: str) -> Column:
    """Whether ``text`` fits: ``exact`` and ``contains`` after case, blanks and compatible forms (NFKC) are evened out, ``regex`` as it is."""
    even = lambda c: F.trim(F.regexp_replace(F.lower(nfkc(c)), "\\s+", " "))
    tests = {"exact": lambda: even(text) == even(expected), "contains": lambda: F.contains(even(text), even(expected)), "regex": lambda: F.regexp_like(text, expected)}
    return tests[mode]()


def value_verdict(predicted: Column, gold: Column) -> Column:
    """``exact``, ``partial`` if one holds the other, else ``wrong``; punctuation, case, blanks and compatible forms (NFKC) don't count. A null is wrong."""
    a, b = (F.trim(F.regexp_replace(F.regexp_replace(F.lower(nfkc(c)), "[^\\p{L}\\p{N}\\s]", " "), "\\s+", " ")) for c in (predicted, gold))
    return F.when(a == b, "exact").when((a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a)), "partial").otherwise("wrong")


def evidence_ratio(evidence: Column, document: Column) -> Column:
    """1 if the document holds the evidence, else the share of the evidence's distinct 3-grams in it; 0 without evidence."""
    e, d = evidence_form(evidence), evidence_form(document)
    mine = F.array_distinct(char_ngrams(e, 3, keep_spaces=True))
    share = F.size(F.array_intersect(mine, char_ngrams(d, 3, keep_spaces=True))) / F.size(mine)
    return F.when(e == "", 0.0).when(F.contains(d, e), 1.0).otherwise(F.round(share, 4))


def adopt(items: DataFrame, key: str, order: str, grounded: str) -> DataFrame:
    """``items`` (question, answer, evidence) with ``reason``: null if kept, else schema, duplicate or ungrounded.

    A question is a duplicate if a kept one before it has the same key; one
    that was turned down bars no later one.
    """
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    whole = (text("question") != "") & (text("answer") != "") & (text("evidence") != "")
    rows = items.withColumns({"_q": question_key(F.coalesce("question", F.lit(""))), "_whole": whole})
    good = F.col("_whole") & (F.col("_q") != "") & F.col(grounded)
    rows = rows.withColumn("_first", F.min(F.when(good, F.col(order))).over(Window.partitionBy(key, "_q")))
    again = (F.col("_q") == "") | F.coalesce(F.col(order) > F.col("_first"), F.lit(False))
    reason = F.when(~F.col("_whole"), "schema").when(again, "duplicate").when(~F.col(grounded), "ungrounded")
    return rows.withColumn("reason", reason).drop("_q", "_whole", "_first")


def health(runs: DataFrame, requested: str, produced: str, reasons: list[str]) -> DataFrame:
    """``runs`` with yield rate (over 1 if too many came) and the rate of each reason; null without candidates."""
    candidates = sum((F.col(r) for r in reasons), F.col(produced))
    rates = {f"{r}_rate": ratio(F.col(r), candidates, None) for r in reasons}
    return runs.withColumns({"yield_rate": ratio(F.col(produced), F.col(requested), None), "overproduced": F.col(produced) > F.col(requested), **rates})


def grounding(pairs: DataFrame, key: str, answer: str, source: str, size: int = 3) -> DataFrame:
    """(key, n, mean_overlap, min_overlap, best_mean) over an answer's sentences.

    Overlap: share of a sentence's distinct word n-grams that the source has
    in any sentence. ``best_mean``: mean of each sentence's best Jaccard with
    one source sentence. Both come from an equi-join on (key, n-gram).
    """
    def side(text: str, i: str) -> DataFrame:
        s = pairs.select(key, F.posexplode(sentences(F.col(text))).alias(i, "x"))
        grams = F.array_distinct(word_ngrams(F.col("x"), size))
        return s.select(key, i, F.size(grams).alias(f"n_{i}"), F.explode(grams).alias("g"))

    a, b = side(answer, "i"), side(source, "j")
    met = a.join(b, [key, "g"])
    hits = met.groupBy(key, "i").agg(F.count_distinct("g").alias("hit"))
    best = met.groupBy(key, "i", "j").agg((F.count(F.lit(1)) / (F.first("n_i") + F.first("n_j") - F.count(F.lit(1)))).alias("jac"))
    best = best.groupBy(key, "i").agg(F.max("jac").alias("best"))
    rows = a.groupBy(key, "i").agg(F.first("n_i").alias("n")).join(hits, [key, "i"], "left").join(best, [key, "i"], "left")
    share = F.round(F.coalesce("hit", F.lit(0)) / F.col("n"), 4)
    return rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(share), 4).alias("mean_overlap"), F.min(share).alias("min_overlap"),
        F.round(F.avg(F.round(F.coalesce("best", F.lit(0.0)), 4)), 4).alias("best_mean"),
    )


def ending_class(sentence: Column) -> Column:
    body, out = F.regexp_replace(sentence, "[ .!?…]+$", ""), None
    for name, shape in ENDINGS:
        out = (F.when if out is None else out.when)(body.rlike(shape), name)
    return out.otherwise("other")


def ending_consistency(texts: DataFrame, key: str, text: str, least: int = 4) -> DataFrame:
    """(key, n, front, back, consistent): the commonest ending of both halves of a text's sentences.

    Sentences of no class don't count; below ``least`` others nothing is
    measured (null). On ties the name first in the alphabet stands.
    """
    s = texts.select(key, F.posexplode(sentences(F.col(text))).alias("i", "x")).withColumn("c", ending_class(F.col("x"))).where("c <> 'other'")
    w = Window.partitionBy(key)
    s = s.withColumns({"_r": F.row_number().over(w.orderBy("i")), "_n": F.count(F.lit(1)).over(w)})
    halves = s.groupBy(key, "c").agg(F.max("_n").alias("n"), *[F.count_if(t).alias(h) for h, t in (("_f", F.col("_r") <= F.floor(F.col("_n") / 2)), ("_b", F.col("_r") > F.floor(F.col("_n") / 2)))])
    top = lambda h: F.when(F.max("n") >= least, F.min(F.struct(-F.col(h), F.col("c").alias("c")))["c"])
    out = halves.groupBy(key).agg(F.max("n").alias("n"), top("_f").alias("front"), top("_b").alias("back"))
    out = texts.select(key).distinct().join(out, key, "left").na.fill(0, ["n"])
    return out.withColumn("consistent", F.col("front") == F.col("back"))


def _fits(shape: str):
    return lambda x: x.rlike(shape)


def tone_check(texts: DataFrame, key: str, text: str, tone: str, doc_type: str) -> DataFrame:
    """(key, applied, forced, n, ending_rate, forbidden): a text by the rules of its tone; some kinds of documents force one.

    Of a tone without rules rate and hits are null: not scored, not passed.
    """
    forced = F.create_map(*[F.lit(x) for kv in FORCED.items() for x in kv])[F.col(doc_type)]
    rows = texts.withColumn("_applied", F.coalesce(forced, F.col(tone)))
    s = F.transform(sentences(F.col(text)), lambda x: F.regexp_replace(x, "[ .!?…]+$", ""))
    rate = hits = None
    for name, (ends, bad) in TONES.items():
        here = F.col("_applied") == name
        part = ratio(F.size(F.filter(s, _fits(ends))), F.size(s))
        rate = (F.when if rate is None else rate.when)(here, part)
        n = sum((F.regexp_count(F.col(text), F.lit(p)) for p in bad), F.lit(0))
        hits = (F.when if hits is None else hits.when)(here, n)
    return rows.select(key, F.col("_applied").alias("applied"), F.coalesce(forced != F.col(tone), F.lit(False)).alias("forced"), F.size(s).alias("n"), rate.alias("ending_rate"), hits.alias("forbidden"))


def particle_errors(texts: DataFrame, key: str, text: str, nouns: DataFrame, noun: str) -> DataFrame:
    """(key, checked, errors): words made of one of ``nouns`` and a particle, and those whose particle doesn't agree."""
    w = texts.select(key, F.explode(words(F.col(text))).alias("w")).select(key, particle_check(F.col("w")).alias("p")).where("p IS NOT NULL").select(key, "p.*")
    known = w.join(nouns.select(F.col(noun).alias("stem")).distinct(), "stem", "left_semi")
    return known.groupBy(key).agg(F.count(F.lit(1)).alias("checked"), F.count_if(F.col("used") != F.col("expected")).alias("errors"))


def numeric_guard(units: DataFrame, source: str, result: str, drift: Column, revert: bool) -> DataFrame:
    """``units`` with ``drifted``, and ``result`` put back to the source where it drifted if ``revert``."""
    rows = units.withColumn("drifted", F.coalesce(drift, F.lit(False)))
    return rows.withColumn(result, F.when(F.col("drifted"), F.col(source)).otherwise(F.col(result))) if revert else rows


def fallback_rate(records: DataFrame, given: str, back: str, fallback: str) -> DataFrame:
    """One row: share of fallbacks, and of records whose counts of segments differ; nulls aren't measured."""
    return records.agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(F.col(fallback).cast("int")), 4).alias("fallback_rate"),
        F.round(F.avg((F.col(given) != F.col(back)).cast("int")), 4).alias("mismatch_rate"),
    )
