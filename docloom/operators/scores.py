"""Scores of text pairs, extraction results and request logs."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import ratio
from ..functions.text import WS


def prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    p, r = tp / (tp + fp), tp / (tp + fn)
    f1 = F.when(tp == 0, 0.0).otherwise(F.round(2 * p * r / (p + r), 4))
    return [ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), f1.alias("f1")]


def extraction_scores(predicted: DataFrame, gold: DataFrame, key: list[str], by: str) -> DataFrame:
    """tp, fp, fn and P/R/F for each field and overall (null): a full outer match of (key, field, value).

    ``predicted`` and ``gold`` hold ``key``, ``by`` and ``value``.
    """
    p, g = predicted.withColumnRenamed("value", "_p"), gold.withColumnRenamed("value", "_g")
    met = p.join(g, [*key, by], "full_outer")
    hit = F.col("_p").eqNullSafe(F.col("_g")) & F.col("_p").isNotNull()
    out = met.rollup(by).agg(
        F.count_if(hit).alias("tp"),
        F.count_if(F.col("_p").isNotNull() & ~hit).alias("fp"),
        F.count_if(F.col("_g").isNotNull() & ~hit).alias("fn"),
    )
    return out.select(by, "tp", "fp", "fn", *prf(F.col("tp"), F.col("fp"), F.col("fn")))


def _overlaps(sizes: range):
    def of(a: str, b: str, n: int) -> list[int]:
        # a text shorter than a gram is its own gram
        x, y = (Counter(t[i : i + n] for i in range(max(len(t) - n + 1, min(len(t), 1)))) for t in (a, b))
        small, large = sorted((x, y), key=len)
        return [sum(min(c, large[g]) for g, c in small.items() if g in large), x.total(), y.total()]

    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        reach = lambda a, b: sizes if len(sizes) == 1 else [n for n in sizes if min(len(a), len(b)) >= n]
        return pd.Series([[of(a, b, n) for n in reach(a, b)] for a, b in zip(left, right, strict=True)], dtype=object)

    return F.pandas_udf(run, "array<array<bigint>>")


def _gram_overlaps(pairs: DataFrame, key: str, a: str, b: str, sizes: range) -> DataFrame:
    """(key, orders): for each order of character n-grams that both sides reach (or a single one) how many both have, and how many each has.

    Each row of pairs is compared by itself in the task that holds it, whatever its key; grams are neither shuffled nor spilled.
    """
    clean = [F.coalesce(F.regexp_replace(c, WS, ""), F.lit("")) for c in (a, b)]
    return pairs.select(key, _overlaps(sizes)(*clean).alias("orders"))


def pair_similarity(pairs: DataFrame, key: str, a: str, b: str, size: int = 3) -> DataFrame:
    """(key, similarity): multiset Jaccard of character n-grams, one row a row of ``pairs``; 1 if both are empty.

    Null texts are empty. Rows that share a key, or have none, are compared each by their own texts.
    """
    one = F.get("orders", F.lit(0))
    share = one[0] / F.nullif(one[1] + one[2] - one[0], F.lit(0))
    return _gram_overlaps(pairs, key, a, b, range(size, size + 1)).select(key, F.coalesce(F.round(share, 4), F.lit(1.0)).alias("similarity"))


def chrf(pairs: DataFrame, key: str, candidate: str, reference: str, max_n: int = 6, beta: float = 2.0) -> DataFrame:
    """(key, chrf): character n-gram F-score, orders 1 to ``max_n`` that both sides have, precision and recall averaged; one row a row of ``pairs``.

    0 if a side is empty, and null texts are. Rows that share a key, or have none, are scored each by their own texts.
    """
    mean = lambda side: F.aggregate("orders", F.lit(0.0), lambda acc, x: acc + x[0] / x[side]) / F.nullif(F.size("orders"), F.lit(0))
    means = _gram_overlaps(pairs, key, candidate, reference, range(1, max_n + 1)).select(key, mean(1).alias("p"), mean(2).alias("r"))
    b2 = beta * beta
    f = F.when(F.col("p") + F.col("r") == 0, 0.0).otherwise((1 + b2) * F.col("p") * F.col("r") / (b2 * F.col("p") + F.col("r")))
    return means.select(key, F.coalesce(F.round(f, 4), F.lit(0.0)).alias("chrf"))


def multiset_diff(left: DataFrame, right: DataFrame, key: str, item: str) -> DataFrame:
    """(key, item, missing, added): how often more an item stands left, or right; equal counts go.

    A key's items are one multiset a side, in however many rows they come; null keys are one, and null items are alike.
    """
    both = left.select(key, item, F.lit(1).alias("d")).unionByName(right.select(key, item, F.lit(-1).alias("d")))
    n = both.groupBy(key, item).agg(F.sum("d").alias("d")).where("d <> 0")
    return n.select(key, item, F.greatest("d", F.lit(0)).alias("missing"), F.greatest(-F.col("d"), F.lit(0)).alias("added"))


def request_summary(records: DataFrame, by: str, seconds: str, ok: Column, limit: float) -> DataFrame:
    """Requests by scenario and in all (null): count, ok, within the limit, p50, p95, max, verdict."""
    out = records.rollup(by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(ok).alias("n_ok"),
        F.count_if(ok & (F.col(seconds) <= limit)).alias("n_within"),
        F.round(F.percentile(seconds, F.lit(0.5)), 2).alias("p50"),
        F.round(F.percentile(seconds, F.lit(0.95)), 2).alias("p95"),
        F.round(F.max(seconds), 2).alias("max_s"),
    )
    return out.withColumn("passed", F.col("n") == F.col("n_within"))
