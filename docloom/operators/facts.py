"""Facts of a text against those of another: numbers, dates, units and names as multisets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import DATES, canonical_date, strip_dates

# Korean units, units in Latin letters, and the shape of a capitalised name.
UNITS = "퍼센트|만원|억원|천원|개월|시간|달러|원|건|명|개|일|주|년|월|분|초|평|%|㎡"
LATIN_UNITS = "USD|KRW|kg|km|cm|mm|g|t|m"
NAME = "\\b[A-Z][A-Za-z0-9&.\\-]+\\b"
KINDS = ("numbers", "dates", "units", "entities")


def extract_dates(text: Column) -> Column:
    """Dates in order, the longest shape at each place, as YYYY-MM-DD, YYYY-MM or MM-DD."""
    return F.transform(F.regexp_extract_all(text, F.lit("|".join(DATES)), F.lit(0)), canonical_date)


def extract_units(text: Column) -> Column:
    """Units right after a digit or blank, in order; one in Latin letters must end there."""
    return F.regexp_extract_all(text, F.lit(f"(?<=[0-9\\s])(?:{UNITS}|(?:{LATIN_UNITS})(?![A-Za-z]))"), F.lit(0))


def extract_entities(text: Column, given: list[str] = ()) -> Column:
    """Capitalised Latin names and the given terms that the text holds, sorted, each once."""
    names = F.regexp_extract_all(text, F.lit(NAME), F.lit(0))
    held = [F.when(F.contains(text, F.lit(t)), F.lit(t)) for t in given]
    return F.array_sort(F.array_distinct(F.concat(names, F.array_compact(F.array(*held)))) if held else F.array_distinct(names))


def facts(text: Column, given: list[str] = ()) -> Column:
    """Array of (kind, item); numbers and units are those outside dates. A null text has none."""
    body = strip_dates(text)
    found = {
        "numbers": F.transform(F.regexp_extract_all(body, F.lit("[-+]?[0-9]{1,3}(?:,[0-9]{3})+(?:\\.[0-9]+)?|[-+]?[0-9]+(?:\\.[0-9]+)?"), F.lit(0)), lambda x: F.replace(x, F.lit(","), F.lit(""))),
        "dates": extract_dates(text), "units": extract_units(body), "entities": extract_entities(text, given),
    }
    named = lambda k, v: F.transform(v, lambda x: F.struct(F.lit(k).alias("kind"), x.alias("item")))
    every = F.flatten(F.array(*[named(k, v) for k, v in found.items()]))
    return F.coalesce(every, F.array().cast("array<struct<kind:string,item:string>>"))


def _by_row(pairs: DataFrame, key: str, source: str, result: str, given: list[str]) -> DataFrame:
    """(_row, key, kind, item, dropped, added): for each row the facts of which its texts hold different numbers, and one row without a fact where there are none.

    A row of pairs is a group of its own, whatever its key, and nothing is
    joined: both texts' facts leave the row together and are summed before the shuffle.
    """
    def side(text: str, n: int) -> Column:
        return F.transform(facts(F.col(text), given), lambda f: F.struct(f["kind"].alias("kind"), f["item"].alias("item"), F.lit(n).alias("n")))

    sides = F.concat(side(source, 1), side(result, -1))
    rows = pairs.select(F.monotonically_increasing_id().alias("_row"), F.col(key), sides.alias("f"))  # numbered before they are spread
    rows = rows.select("_row", key, F.explode_outer("f").alias("f"))
    off = rows.groupBy("_row", key, "f.kind", "f.item").agg(F.coalesce(F.sum("f.n"), F.lit(0)).alias("off"))
    return off.select("_row", key, "kind", "item", F.greatest("off", F.lit(0)).alias("dropped"), F.greatest(-F.col("off"), F.lit(0)).alias("added"))


def fact_differences(pairs: DataFrame, key: str, source: str, result: str, given: list[str] = ()) -> DataFrame:
    """(key, kind, item, dropped, added): facts of which source and result hold different numbers; counts sum before the shuffle.

    Each row of pairs is compared by itself: rows that share a key, or have none, give their own. Null texts have no facts.
    """
    return _by_row(pairs, key, source, result, given).where("dropped + added > 0").drop("_row")


def cross_check(pairs: DataFrame, key: str, source: str, result: str, given: list[str] = ()) -> DataFrame:
    """(key, numbers, dates, units, entities, passed): how many facts of each kind were dropped or added; one row a row of ``pairs``.

    Rows that share a key, or have none, are checked each by their own texts.
    Null texts have no facts, so two of them pass.
    """
    n = F.col("dropped") + F.col("added")
    out = _by_row(pairs, key, source, result, given).groupBy("_row", key).agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, n)), F.lit(0)).alias(k) for k in KINDS])
    return out.drop("_row").withColumn("passed", F.col(KINDS[0]) + F.col(KINDS[1]) + F.col(KINDS[2]) + F.col(KINDS[3]) == 0)


def issue_texts(pairs: DataFrame, key: str, source: str, result: str, most: int = 5) -> DataFrame:
    """(key, kind, n_issues, first): how many items of a kind differ, and the first ``most`` of them in order, as text.

    Rows that share a key, or have none, give their own. Rows whose numbers and dates agree give none.
    """
    off = _by_row(pairs, key, source, result, []).where("kind IN ('numbers', 'dates') AND dropped + added > 0")
    sign = F.concat(F.when(F.col("dropped") > 0, "-").otherwise("+"), F.col("item"))
    out = off.groupBy("_row", key, "kind").agg(F.sum(F.col("dropped") + F.col("added")).alias("n_issues"), F.array_join(F.slice(F.sort_array(F.collect_list(sign)), 1, most), ", ").alias("first"))
    return out.drop("_row")


def fact_pass_rate(checked: DataFrame) -> DataFrame:
    """(items, pass_rate): over the rows of ``cross_check``; null without rows."""
    n = F.count(F.lit(1))
    return checked.agg(n.alias("items"), F.round(F.count_if("passed") / F.nullif(n, F.lit(0)), 4).alias("pass_rate"))
