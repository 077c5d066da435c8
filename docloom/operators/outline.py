"""Outlines of numbered documents: levels, labels, the ladder in use, and titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Marks at the head of a paragraph and their levels, of statutes and of office documents.
ITEMS = "가나다라마바사아자차카타파하"
ROMAN = "ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩ"
STATUTE = [
    (1, "^제\\s*\\d+\\s*편(?![가-힣])"),
    (2, "^제\\s*\\d+\\s*장(?![가-힣])"),
    (2, "^부\\s*칙(?=[\\s(<\\[]|$)"),
    (3, "^제\\s*\\d+\\s*절(?![가-힣])"),
    (4, "^제\\s*\\d+\\s*관(?![가-힣])"),
    (5, "^제\\s*\\d+\\s*조(?:\\s*의\\s*\\d+)?(?![가-힣])"),
    (6, "^[①-⑳]"),
    (7, "^\\d{1,2}\\.(?=\\s)"),
    (8, f"^[{ITEMS}]\\.(?=\\s)"),
]
OFFICE = [
    (1, f"^[{ROMAN}][.．](?=\\s|$)"),
    (1, "^제\\s*\\d+\\s*장(?![가-힣])"),
    (2, "^\\d{1,2}[.．](?=\\s|[가-힣A-Za-z])"),
    (3, f"^[{ITEMS}][.．](?=\\s|[가-힣A-Za-z])"),
    (4, "^\\d{1,2}[)）](?=\\s|[가-힣A-Za-z])"),
    (5, f"^[{ITEMS}][)）](?=\\s|[가-힣A-Za-z])"),
    (6, "^[(（]\\d{1,2}[)）](?=\\s|[가-힣A-Za-z])"),
    (7, "^[①-⑳]"),
]
ARTICLE = 5
LABEL_CHARS = 40
SENTENCE_ENDS = "(?:다\\.|요\\.|다\\)|요\\)|임\\.|함\\.)$"


def _trim(text: Column) -> Column:
    return F.regexp_replace(text, "^\\s+|\\s+$", "")


def _ladder(text: Column, rules: list[tuple[int, str]], of) -> Column:
    out = None
    for level, shape in rules:
        out = (F.when if out is None else out.when)(text.rlike(shape), of(level, shape))
    return out


def level_of(text: Column, rules: list[tuple[int, str]] = STATUTE) -> Column:
    """Level of the mark at a paragraph's head; 0 without one."""
    return F.coalesce(_ladder(_trim(text), rules, lambda level, _: F.lit(level)), F.lit(0))


def label_of(text: Column, rules: list[tuple[int, str]] = STATUTE) -> Column:
    """Mark with its title in brackets, or the whole of a short paragraph, or the mark; null without a mark."""
    t = _trim(text)
    mark = _ladder(t, rules, lambda _, shape: F.regexp_extract(t, shape, 0))
    titled = _ladder(t, rules, lambda _, shape: F.regexp_extract(t, f"{shape}(?=\\s*\\()", 0))
    title = F.regexp_extract(F.substring(t, F.length(mark) + 1, F.length(t)), "^\\s*(\\([^)]*\\))", 1)
    return F.when((titled != "") & (title != ""), F.concat(_trim(mark), title)).when(F.length(t) <= LABEL_CHARS, F.when(mark.isNotNull(), t)).otherwise(_trim(mark))


def is_candidate(text: Column) -> Column:
    """Whether a paragraph may be an office document's heading: short, and not a sentence."""
    t = _trim(text)
    return F.length(t).between(1, LABEL_CHARS) & ~t.rlike(SENTENCE_ENDS)


def ordinal_of(mark: Column) -> Column:
    """Place that a mark names: its digits, or the place of its letter, Roman or circled number; 0 without one."""
    digits = F.nullif(F.regexp_extract(mark, "\\d{1,2}", 0), F.lit(""))
    sign = F.regexp_extract(mark, f"[{ITEMS}{ROMAN}①-⑳]", 0)
    places = [F.instr(F.lit(row), sign) for row in (ITEMS, ROMAN, "".join(map(chr, range(0x2460, 0x2474))))]
    return F.when(digits.isNotNull(), digits.cast("int")).when(sign != "", F.greatest(*places)).otherwise(0)


def outline_mode(blocks: DataFrame, key: str, text: str = "text", least: int = 2) -> DataFrame:
    """(key, mode): ``statute`` for documents with at least two articles, else ``off``."""
    article = level_of(F.col(text)) == ARTICLE
    return blocks.groupBy(key).agg(F.when(F.count_if(article) >= least, "statute").otherwise("off").alias("mode"))


def office_levels(blocks: DataFrame, key: str, order: str, text: str = "text") -> DataFrame:
    """(key, level) that a document uses: two marks or more, the first of them number 1."""
    t = _trim(F.col(text))
    rows = blocks.where(is_candidate(F.col(text))).select(
        key, F.col(order).alias("o"), level_of(F.col(text), OFFICE).alias("level"), ordinal_of(_ladder(t, OFFICE, lambda _, s: F.regexp_extract(t, s, 0))).alias("n")
    )
    sums = rows.where("level > 0").groupBy(key, "level").agg(F.count(F.lit(1)).alias("hits"), F.min_by("n", "o").alias("first"))
    return sums.where("hits >= 2 AND first = 1").select(key, "level")


def office_outline(blocks: DataFrame, key: str, order: str, text: str = "text") -> DataFrame:
    """``blocks`` with ``level`` and ``label`` by the marks that each document uses as headings; 0 and null elsewhere."""
    rows = blocks.withColumn("_l", F.when(is_candidate(F.col(text)), level_of(F.col(text), OFFICE)).otherwise(0))
    used = office_levels(blocks, key, order, text).withColumnRenamed("level", "_l").withColumn("_u", F.lit(True))
    out = rows.join(used, [key, "_l"], "left")
    return out.withColumns({"level": F.when(F.col("_u"), F.col("_l")).otherwise(0), "label": F.when(F.col("_u"), label_of(F.col(text), OFFICE))}).drop("_l", "_u")


def drop_bare_headings(chunks: DataFrame, key: str, order: str, text: str, path: str) -> DataFrame:
    """Chunks without those that only repeat their own label while the next chunk stands below them."""
    w = Window.partitionBy(key).orderBy(order)
    mine, following = F.col(path), F.lead(path).over(w)
    own = F.col(text) == F.get(mine, F.size(mine) - 1)
    below = (F.size(following) >= F.size(mine)) & (F.slice(following, F.lit(1), F.size(mine)) == mine)
    return chunks.withColumn("_bare", F.coalesce(own & (F.size(mine) > 0) & below, F.lit(False))).where(~F.col("_bare")).drop("_bare")


def title_tables(blocks: DataFrame, key: str, order: str, kind: str = "kind", text: str = "text", limit: int = 60) -> DataFrame:
    """``blocks`` with ``table_title``: a table takes the short one-line paragraph right before it."""
    w = Window.partitionBy(key).orderBy(order)
    before = F.lag(text).over(w)
    fits = (F.lag(kind).over(w) == "paragraph") & F.length(before).between(1, limit) & ~before.contains("\n")
    return blocks.withColumn("table_title", F.when((F.col(kind) == "table") & fits, before))
