"""Templates: slots in text, the fields they make up, repeated groups, and numbers of outline levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Quotes that open a slot's name, each with those that may close it; letters of numbered lists.
QUOTES = {"'": "'’", "‘": "'’", '"': '"”', "“": '"”'}
SYLLABLES, JAMO = "가나다라마바사아자차카타파하", "ㄱㄴㄷㄹㅁㅂㅅㅇㅈㅊㅋㅌㅍㅎ"
LATIN = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ROMAN = [("m", 1000), ("cm", 900), ("d", 500), ("cd", 400), ("c", 100), ("xc", 90), ("l", 50), ("xl", 40), ("x", 10), ("ix", 9), ("v", 5), ("iv", 4), ("i", 1)]

_OPEN, _CLOSE = "".join(QUOTES), "".join(dict.fromkeys("".join(QUOTES.values())))
_SLOT = rf"\{{\s*([{_OPEN}])([^{_OPEN}{_CLOSE}{{}}]*)([{_CLOSE}])([^{{}}]*)\}}"
FIELD = "CLICK_HERE"


def slots(text: Column) -> Column:
    """The slots ``{'name', args}`` of a text in order, as an array of (name, args); args are what follows the name and its separator.

    Quotes must pair, names must not be blank, and what stands between double
    braces is no slot. A null text gives an empty array.
    """
    found = F.regexp_extract_all(F.regexp_replace(F.coalesce(text, F.lit("")), r"\{\{[^{}\r\n]+\}\}", " "), F.lit(_SLOT), F.lit(0))
    paired = F.create_map(*[F.lit(x) for pair in QUOTES.items() for x in pair])

    def part(x: Column, n: int) -> Column:
        return F.regexp_extract(x, _SLOT, n)

    good = F.filter(found, lambda x: F.contains(paired[part(x, 1)], part(x, 3)) & (F.trim(part(x, 2)) != ""))
    return F.transform(good, lambda x: F.struct(F.trim(part(x, 2)).alias("name"), F.regexp_replace(part(x, 4), r"^[\s,/·|]+|\s+$", "").alias("args")))


def strip_echoed_name(name: Column, value: Column) -> Column:
    """A value without its field's name and colon in front; null where either is null."""
    text = F.trim(value)
    out = text
    for colon in ("：", ":"):
        prefix = F.concat(name, F.lit(colon))
        out = F.when(F.startswith(text, prefix), F.trim(F.substring(text, F.length(prefix) + 1, F.length(text)))).otherwise(out)
    return out


def merge_fields(places: DataFrame, key: str) -> DataFrame:
    """One row a key and name from places (key, pos, name, guide, field_type, value, filled), by partial aggregates.

    A field is filled only if all of its places are; its value is that of the
    first filled place, its guide the first that isn't empty. A form field
    stands for slots of its name. ``pos`` is the first place. Nulls count as
    empty and not filled; ties of ``pos`` go to the smaller text.
    """
    guide, value = F.coalesce("guide", F.lit("")), F.trim(F.coalesce("value", F.lit("")))
    filled, field = F.coalesce("filled", F.lit(False)), F.coalesce(F.col("field_type") == FIELD, F.lit(False))

    def first(of: Column, where: Column) -> Column:
        return F.min(F.when(where, F.struct("pos", of.alias("x"))))["x"]

    return places.groupBy(key, "name").agg(
        F.min("pos").alias("pos"),
        F.coalesce(first(guide, guide != ""), F.lit("")).alias("guide"),
        F.when(F.max(field), FIELD).otherwise(first(F.col("field_type"), F.lit(True))).alias("field_type"),
        F.count(F.lit(1)).alias("occurrences"),
        F.min(filled).alias("filled"),
        F.coalesce(first(value, filled), F.lit("")).alias("current_value"),
        F.when(F.max(field), "field").otherwise("slot").alias("source"),
    )


def group_counts(values: DataFrame, key: str, outer: str, inner: str, max_outer: int, max_inner: int) -> DataFrame:
    """(key, k, n_inner): the copies of a repeated group that values (key, name, value) ask for.

    ``outer`` and ``inner`` are patterns of names, with the number of the copy
    as group 1 and, in ``inner``, of the item within it as group 2. The
    greatest number with a value that isn't blank counts; copies below it have
    one item at least, and every key has one copy. Numbers over the limits and
    other names are ignored. Per key at most ``max_outer`` numbers are gathered.
    """
    inside = F.regexp_extract("name", inner, 0) != ""
    at = F.when(inside, F.regexp_extract("name", inner, 1)).otherwise(F.regexp_extract("name", outer, 1))
    k, j = at.try_cast("int"), F.when(inside, F.regexp_extract("name", inner, 2).try_cast("int")).otherwise(1)
    used = F.coalesce((F.trim("value") != "") & k.between(1, max_outer) & j.between(1, max_inner), F.lit(False))
    each = values.select(key, F.when(used, k).alias("k"), F.when(used, j).alias("j")).groupBy(key, "k").agg(F.max("j").alias("j"))
    pairs = F.collect_list(F.when(F.col("k").isNotNull(), F.struct("k", "j")))
    by_key = each.groupBy(key).agg(F.coalesce(F.max("k"), F.lit(1)).alias("copies"), F.map_from_entries(pairs).alias("items"))
    rows = by_key.select(key, "items", F.explode(F.sequence(F.lit(1), "copies")).alias("k"))
    return rows.select(key, "k", F.coalesce(F.try_element_at("items", F.col("k")), F.lit(1)).alias("n_inner"))


def roman(number: Column) -> Column:
    """A whole number in small roman letters; below 1 the empty text, null for null."""
    out, rest = [], F.when(number < 0, 0).otherwise(number).cast("int")
    for letters, value in ROMAN:
        out.append(F.repeat(F.lit(letters), F.floor(rest / value).cast("int")))
        rest = rest % value
    return F.concat(*out)


def format_number(number: Column, form: Column) -> Column:
    """A list number in its form: at the end of their row letters start again, doubled, then tripled; below 1 they are empty.

    Unknown and null forms give digits, a null number null.
    """

    def cycle(letters: str) -> Column:
        letter = F.substring(F.lit(letters), F.pmod(number - 1, F.lit(len(letters))).cast("int") + 1, F.lit(1))
        return F.when(number < 1, "").otherwise(F.repeat(letter, (F.floor((number - 1) / len(letters)) + 1).cast("int")))

    def circled(first: int, last: int, other: Column) -> Column:
        signs = "".join(chr(first + i) for i in range(last))
        return F.when(number.between(1, last), F.substring(F.lit(signs), number.cast("int"), F.lit(1))).otherwise(other)

    plain, letters, small = number.cast("string"), cycle(LATIN), roman(number)
    forms = {
        "HANGUL_SYLLABLE": cycle(SYLLABLES), "HANGUL_JAMO": cycle(JAMO), "CIRCLED_DIGIT": circled(0x2460, 20, plain),
        "CIRCLED_HANGUL_SYLLABLE": circled(0x326E, 14, cycle(SYLLABLES)), "CIRCLED_HANGUL_JAMO": circled(0x3260, 14, cycle(JAMO)),
        "LATIN_CAPITAL": letters, "LATIN_SMALL": F.lower(letters), "ROMAN_CAPITAL": F.upper(small), "ROMAN_SMALL": small,
    }
    out = plain
    for name, value in forms.items():
        out = F.when(form == name, value).otherwise(out)
    return out


def level_numbers(rows: DataFrame, key: str, order: list[str], level: str, levels: int = 10) -> DataFrame:
    """Add ``number``: the count of rows of this level since the last row of a higher one (a smaller ``level``).

    ``order`` must tell the rows of a key apart, but for rows of one level. Two windows over the key, both
    running; rows whose level is null or outside 1 to ``levels`` have no number
    and start nothing anew.
    """
    running = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    at = F.when(F.col(level).between(1, levels), F.col(level).cast("int"))
    above = F.array(*[F.count(F.when(at < n, 1)).over(running) for n in range(1, levels + 1)])
    seen = rows.withColumn("_above", F.get(above, at - 1))
    same = Window.partitionBy(key, level, "_above").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return seen.withColumn("number", F.when(at.isNotNull(), F.count(F.lit(1)).over(same))).drop("_above")


def resolve_count(requested: Column, limit: int, default: int) -> Column:
    """(count, clamped): a requested number from 0 to ``limit``; what is no number gives ``default``."""
    asked = F.greatest(F.coalesce(F.trim(requested).try_cast("int"), F.lit(default)), F.lit(0))
    return F.struct(F.least(asked, F.lit(limit)).alias("count"), (asked > limit).alias("clamped"))
