"""Personal data in texts: where it stands, never what it says."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.collections import prefix
from ..functions.numbers import valid_business, valid_card, valid_resident
from ..functions.text import let, strip_display_tags

# Korean family names of two syllables and of one, what may follow a given name, and what isn't one.
FAMILY_2 = "남궁 황보 제갈 선우 서문 사공 독고 동방".split()
FAMILY_1 = (
    "김 이 박 최 정 강 조 윤 장 임 한 오 신 서 권 황 안 송 전 홍 유 고 문 양 손 배 백 허 남 심 노 하 곽 성 차 주 우 구 민 나 "
    "진 지 엄 채 원 천 방 공 현 함 변 염 여 추 도 소 석 선 설 마 길 연 위 표 명 기 반 왕 금 옥 육 인 맹 제 모 탁 국 편 용 예 "
    "봉 사 화 부 가 복 동 두 목 형 계 피 감 음 태 경 어 좌"
).split()
TITLES = (
    "선생님 고객님 사장님 회장님 대표님 부장님 과장님 차장님 팀장님 실장님 이사님 원장님 님 씨 군 양 "
    "대리 과장 차장 부장 팀장 실장 이사 대표 사원 주임 교수 박사 원장 전무 상무 회장 본부장 지점장 센터장 국장"
).split()
NO_GIVEN_NAME = "것 번 제 후 때 리 래 곳 점 안 밖 속 앞 뒤 든 터 지 께 지만 러분 든지 부터 까지 처럼 마다 라도 조차 마저".split()
# The shape of each kind of identifier, in order of precedence.
SHAPES = {
    "rrn": "(?<![0-9])[0-9]{6}\\s?-\\s?[1-8][0-9]{6}(?![0-9])",
    "biz": "(?<![0-9])[0-9]{3}-[0-9]{2}-[0-9]{5}(?![0-9])",
    "card": "(?<![0-9])(?:[0-9]{4}[- ]){3}[0-9]{4}(?![0-9])",
    "phone": "(?<![0-9])(?:01[016789]|0(?:2|3[1-3]|4[1-4]|5[1-5]|6[1-4]))\\s?-\\s?[0-9]{3,4}\\s?-\\s?[0-9]{4}(?![0-9])",
    "email": "[A-Za-z0-9._%+\\-]+@[A-Za-z0-9.\\-]+\\.[A-Za-z]{2,}",
    "driver_license": "(?<![0-9])[0-9]{2}-[0-9]{2}-[0-9]{6}-[0-9]{2}(?![0-9])",
    "passport": "(?<![0-9A-Za-z])[MSRODmsrod][0-9]{8}(?![0-9A-Za-z])",
}
# Fixed value: an identifier of digits and hyphens with two mask characters in a row or more.
MASKED = "(?<![0-9A-Za-z])(?=[0-9\\-]*[*●#✻]{2,})[0-9\\-*●#✻]{4,}(?![0-9A-Za-z])"


def _any(words: list[str]) -> str:
    return "|".join(sorted(words, key=len, reverse=True))


# A range is one test, a class of single letters one for each: so the range comes first, at all places of a text, and the names only where a Hangul word begins.
_SECOND = "|".join(f"(?<={name[0]}){name[1]}" for name in FAMILY_2)
SHAPES["name"] = f"[가-힣](?<![가-힣].)(?:{_SECOND}|(?<=[{''.join(FAMILY_1)}]))[가-힣]{{1,2}}(?= ?(?:{_any(TITLES)}))"


def valid_name(token: Column) -> Column:
    """A family name with one or two syllables after it that are no common word, and the whole no title."""
    two = F.substring(token, 1, 2).isin(FAMILY_2) & F.length(token).between(3, 4)
    one = F.substring(token, 1, 1).isin(FAMILY_1) & F.length(token).between(2, 3)
    given = F.when(two, F.substring(token, 3, 2)).otherwise(F.substring(token, 2, 2))
    bare = [t[:-1] for t in TITLES if t.endswith("님") and len(t) > 1]
    return (two | one) & ~given.isin(NO_GIVEN_NAME) & ~token.isin([*TITLES, *bare])


CHECKS: dict[str, Callable[[Column], Column]] = {"rrn": valid_resident, "biz": valid_business, "card": valid_card, "name": valid_name}


def places(text: Column, shape: str) -> Column:
    """Array of (start, end, token) of a pattern's matches, in code points from 0.

    What stands between the matches, and the matches, give the offsets, by running sums.
    """
    both = F.struct(F.split(text, shape, -1).alias("between"), F.regexp_extract_all(text, F.lit(shape), F.lit(0)).alias("tokens"))
    none = F.array().cast("array<struct<start:int,end:int,token:string>>")

    def offsets(b: Column) -> Column:
        pairs = F.filter(F.arrays_zip(b["between"], b["tokens"]), lambda x: x["tokens"].isNotNull())
        return let(pairs, lambda p: F.zip_with(p, prefix(F.transform(p, lambda x: F.length(x["between"]) + F.length(x["tokens"])), F.lit(0), lambda a, n: a + n), placed))

    def placed(x: Column, at: Column) -> Column:
        start = at + F.length(x["between"])
        return F.struct(start.alias("start"), (start + F.length(x["tokens"])).alias("end"), x["tokens"].alias("token"))

    # most texts have none: one search tells
    return F.when(text.rlike(shape), let(both, offsets)).otherwise(none)


#: What a text must hold for a kind of identifier to be in it: cheap to look for, once for several kinds.
DIGITS, MAIL, LONG, SYLLABLE, MASKS = "[0-9]{2}[0-9]*\\s?-|[0-9]{4} [0-9]{4}", "@", "[0-9]{8}", "[가-힣]", "[*●#✻]{2}"
NEEDS = {"rrn": DIGITS, "biz": DIGITS, "card": DIGITS, "phone": DIGITS, "driver_license": DIGITS, "email": MAIL, "passport": LONG, "name": SYLLABLE}


def _finds(body: Column, kind: str) -> Column:
    found = places(body, SHAPES[kind])
    if kind in CHECKS:
        found = F.filter(found, lambda x: CHECKS[kind](x["token"]))
    return F.transform(found, lambda x: F.struct(F.lit(kind).alias("category"), x["start"].alias("start"), x["end"].alias("end")))


def personal_data(text: Column) -> Column:
    """Struct (found: array of (category, start, end) by place, masked: how many masked identifiers) of a text.

    Places are those of the text without ``<mark>`` tags. Numbers with a check
    digit must have the right one. Of overlapping finds the earlier kind in
    ``SHAPES`` stands. Values are never given out. A null text has none.
    """
    none = F.array().cast("array<struct<category:string,start:int,end:int>>")
    needs = list(dict.fromkeys(NEEDS.values()))

    def of(body: Column) -> Column:
        held = F.struct(*[(F.contains(body, F.lit(n)) if n == MAIL else body.rlike(n)).alias(f"n{i}") for i, n in enumerate(needs)], body.rlike(MASKS).alias("masks"))
        return let(held, lambda has: finds(body, has))

    def finds(body: Column, has: Column) -> Column:
        taken = none
        for kind in SHAPES:
            new = F.when(has[f"n{needs.index(NEEDS[kind])}"], _finds(body, kind)).otherwise(none)
            taken = let(F.struct(taken.alias("old"), new.alias("new")), lambda s: F.concat(
                s["old"], F.filter(s["new"], lambda x: ~F.exists(s["old"], lambda o: (x["start"] < o["end"]) & (o["start"] < x["end"])))
            ))
        by_place = F.transform(F.array_sort(F.transform(taken, lambda x: F.struct(x["start"], x["end"], x["category"]))), lambda x: F.struct(
            x["category"].alias("category"), x["start"].alias("start"), x["end"].alias("end")
        ))
        return F.struct(by_place.alias("found"), F.when(has["masks"], F.regexp_count(body, F.lit(MASKED))).otherwise(0).alias("masked"))

    return let(strip_display_tags(F.coalesce(text, F.lit(""))), of)


def audit(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, category, start, end): a row for each find."""
    return texts.select(key, F.inline(personal_data(F.col(text))["found"]))


def leaks(texts: DataFrame, text: str) -> DataFrame:
    """(category, n_found, n_texts) over all texts, with a row ``masked`` and one ``all``; kinds that don't occur have none."""
    seen = texts.select(personal_data(F.col(text)).alias("p"))
    of = lambda kind: F.size(F.filter("p.found", lambda x: x["category"] == kind))
    sizes = {"all": F.size("p.found"), "masked": F.col("p.masked")} | {k: of(k) for k in SHAPES}
    counted = F.array(*[F.struct(F.lit(k).alias("category"), n.alias("n")) for k, n in sizes.items()])
    rows = seen.select(F.inline(counted)).where("n > 0")
    return rows.groupBy("category").agg(F.sum("n").alias("n_found"), F.count(F.lit(1)).alias("n_texts"))
