"""Numbers, dates, checksums, budgets and sampling as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Date shapes, the longest first.
DATES = ("[0-9]{4}[-./][0-9]{1,2}[-./][0-9]{1,2}", "[0-9]{4}년 ?[0-9]{1,2}월 ?[0-9]{1,2}일", "[0-9]{4}년 ?[0-9]{1,2}월", "[0-9]{1,2}월 ?[0-9]{1,2}일")


def strip_dates(text: Column) -> Column:
    for shape in DATES:
        text = F.regexp_replace(text, shape, " ")
    return text


def numbers(text: Column, skip_dates: bool = True, kind: str = "double") -> Column:
    """Numbers in order, thousands commas taken out, sign kept."""
    text = strip_dates(text) if skip_dates else text
    found = F.regexp_extract_all(text, F.lit("-?[0-9]+(?:,[0-9]{3})*(?:\\.[0-9]+)?"), F.lit(0))
    return F.transform(found, lambda x: F.regexp_replace(x, ",", "").cast(kind))


def canonical_date(token: Column) -> Column:
    """Three parts to YYYY-MM-DD; two to YYYY-MM, or MM-DD if the first is at most 31."""
    p = F.regexp_extract_all(token, F.lit("[0-9]+"), F.lit(0))
    two = lambda i: F.lpad(F.get(p, F.lit(i)), 2, "0")
    year = F.get(p, F.lit(0))
    return (
        F.when(F.size(p) == 3, F.concat_ws("-", year, two(1), two(2)))
        .when((F.size(p) == 2) & (year.cast("int") > 31), F.concat_ws("-", year, two(1)))
        .when(F.size(p) == 2, F.concat_ws("-", two(0), two(1)))
    )


def number_fingerprint(text: Column) -> Column:
    """Digits of each number with separators and leading zeros taken out, sorted: a multiset."""
    folded = F.translate(text, "０１２３４５６７８９", "0123456789")
    found = F.regexp_extract_all(folded, F.lit("[0-9]+(?:[.,' ][0-9]+)*"), F.lit(0))
    return F.sort_array(F.transform(found, lambda x: F.regexp_replace(F.regexp_replace(x, "[^0-9]", ""), "^0+(?=[0-9])", "")))


def _weighted(token: Column, weights: list[int]) -> Column:
    digits = F.transform(F.split(F.regexp_replace(token, "[^0-9]", ""), ""), lambda x: x.cast("int"))
    pairs = F.zip_with(digits, F.array(*map(F.lit, weights)), lambda a, b: a * F.coalesce(b, F.lit(0)))
    return F.aggregate(pairs, F.lit(0), lambda acc, x: acc + F.coalesce(x, F.lit(0)))


def _digit(token: Column, i: int) -> Column:
    return F.substring(F.regexp_replace(token, "[^0-9]", ""), i, 1).cast("int")


def valid_resident(token: Column) -> Column:
    """13 digits, month and day in range, check digit right."""
    d = F.regexp_replace(token, "[^0-9]", "")
    check = (11 - _weighted(token, [2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5, 0]) % 11) % 10
    month, day = F.substring(d, 3, 2).cast("int"), F.substring(d, 5, 2).cast("int")
    return F.when(F.length(d) == 13, month.between(1, 12) & day.between(1, 31) & (check == _digit(token, 13))).otherwise(F.lit(False))


def valid_business(token: Column) -> Column:
    """10 digits with the right check digit."""
    d = F.regexp_replace(token, "[^0-9]", "")
    total = _weighted(token, [1, 3, 7, 1, 3, 7, 1, 3, 5, 0]) + F.floor(_digit(token, 9) * 5 / 10)
    return F.when(F.length(d) == 10, (10 - total % 10) % 10 == _digit(token, 10)).otherwise(F.lit(False))


def valid_card(token: Column) -> Column:
    """13 to 19 digits that pass the Luhn check."""
    d = F.regexp_replace(token, "[^0-9]", "")
    return F.length(d).between(13, 19) & F.expr("true") & F.call_function("luhn_check", d)


def chunk_budget(chars: Column, n: Column, low: int = 12000, high: int = 40000) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), F.ceil(chars / F.greatest(n, F.lit(1)))))


def compare_threshold(value: Column, operator: str, threshold: float | None = None, low: float | None = None, high: float | None = None) -> Column:
    tests = {"lt": lambda: value < threshold, "gt": lambda: value > threshold, "eq": lambda: value == threshold, "between": lambda: value.between(low, high)}
    return tests[operator]()


def bucket(identifier: Column, salt: str) -> Column:
    """A place in [0, 1) from the first 8 bytes of sha256(salt:id)."""
    head = F.substring(F.sha2(F.concat(F.lit(salt + ":"), identifier.cast("string")), 256), 1, 16)
    return F.conv(head, 16, 10).cast("decimal(20,0)").cast("double") / F.lit(2.0**64)


def sampled(identifier: Column, rate: float, salt: str) -> Column:
    """Whether an id is in the sample: the same ids at every run."""
    return bucket(identifier, salt) < rate


def ratio(a: Column, b: Column, empty: float | None = 0.0) -> Column:
    """a / b to four places, ``empty`` where b is 0."""
    return F.when(b == 0, F.lit(empty)).otherwise(F.round(a / b, 4))
