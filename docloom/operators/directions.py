"""Languages a text may be translated between."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.language import detect

# The languages, those a dictionary exists for, and other names of each.
CODES = ("ko", "en", "zh", "th", "vi", "ru")
WITH_GLOSSARY = ("ko", "en")
ALIASES = {
    "korean": "ko", "kor": "ko", "ko-kr": "ko", "한국어": "ko", "국문": "ko",
    "english": "en", "eng": "en", "en-us": "en", "영어": "en", "영문": "en",
    "chinese": "zh", "zh-cn": "zh", "zh-hans": "zh", "cn": "zh", "중국어": "zh",
    "thai": "th", "th-th": "th", "태국어": "th",
    "vietnamese": "vi", "vi-vn": "vi", "베트남어": "vi",
    "russian": "ru", "ru-ru": "ru", "러시아어": "ru", "노어": "ru",
}
#: Below this share of a text's letters a language counts as absent.
ABSENT = 0.1


def resolve(code: Column) -> Column:
    """The code of a language by its code or another name, in any case; null for others."""
    names = F.create_map(*[F.lit(x) for pair in (ALIASES | {c: c for c in CODES}).items() for x in pair])
    return F.try_element_at(names, F.replace(F.lower(F.trim(F.coalesce(code, F.lit("")))), F.lit("_"), F.lit("-")))


def glossary_applies(source: Column, target: Column) -> Column:
    """Whether a dictionary exists for the target, and for the source or the source isn't a known language."""
    known = F.lower(F.trim(source))
    return F.coalesce(F.lower(F.trim(target)).isin(*WITH_GLOSSARY), F.lit(False)) & (~F.coalesce(known.isin(*CODES), F.lit(False)) | F.coalesce(known.isin(*WITH_GLOSSARY), F.lit(False)))


def resolve_direction(target: Column, source: Column, text: Column, share_of) -> Column:
    """Struct (source, target, detected, mismatch, verdict) of a wished translation.

    ``share_of(text, code)`` gives a language's part of the text's letters. The
    declared source counts; what the text looks like only refuses it where the
    declared language is nearly absent and neither the text's language nor the
    target is Korean. Without a declared source the text's language stands in.
    Verdicts: ok, unknown_language, same_language, source_needed, no_korean,
    other_language.
    """
    given = F.nullif(F.trim(F.coalesce(source, F.lit(""))), F.lit(""))
    declared, to, seen = resolve(given), resolve(target), F.nullif(detect(text)["code"], F.lit(""))
    start = F.coalesce(declared, seen)
    mismatch = F.coalesce(declared != seen, F.lit(False))
    absent = mismatch & (share_of(text, declared) < ABSENT) & (seen != "ko") & (to != "ko")
    verdict = (
        F.when(to.isNull() | (given.isNotNull() & declared.isNull()), "unknown_language")
        .when(start.isNull(), F.when(to == "ko", "ok").otherwise("source_needed"))
        .when(start == to, "same_language")
        .when((start != "ko") & (to != "ko"), "no_korean")
        .when(absent, "other_language")
        .otherwise("ok")
    )
    return F.struct(start.alias("source"), to.alias("target"), seen.alias("detected"), mismatch.alias("mismatch"), verdict.alias("verdict"))
