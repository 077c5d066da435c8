"""String scalars as Column functions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

WS = "[ \\t\\n\\r\\f\\x0B]+"


def strip_display_tags(text: Column) -> Column:
    """Remove ``<mark>`` and ``</mark>`` only, in either case."""
    return F.regexp_replace(text, "(?i)</?mark\\s*>", "")


def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def nfkc(text: Column) -> Column:
    """Unicode's compatible composed form: full-width signs, ligatures and the like as plain ones. Spark has no function for it."""
    return F.pandas_udf(_nfkc, StringType())(text)


def letters_only(text: Column) -> Column:
    """Letters and digits alone, without HTML tags, by which versions of a text are compared."""
    plain = F.regexp_replace(text, "<[^>]+>", " ")
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(sign))
    return F.regexp_replace(nfkc(plain), "[^\\p{L}\\p{N}]+", "")


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, WS), "")


def flat(text: Column) -> Column:
    """Blanks and line feeds as single spaces, trimmed."""
    return F.trim(F.regexp_replace(text, WS, " "))


def counts(text: Column) -> Column:
    """Struct (n_char, n_word, n_line); a text has at least one line."""
    lines = F.size(F.split(text, "\n"))
    return F.struct(F.length(text).alias("n_char"), F.size(words(text)).alias("n_word"), lines.alias("n_line"))


def sentences(text: Column) -> Column:
    """Cut after . ! ? and blanks, after the two Korean sentence ends, and at line feeds; blank pieces go."""
    cut = F.regexp_replace(text, "([.!?])[ \\t\\r\\f\\x0B]+", "$1\n")
    cut = F.regexp_replace(cut, "([다요]\\.)", "$1\n")
    return F.filter(F.transform(F.split(cut, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is worked out once, not again for each use or element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def char_ngrams(text: Column, size: int = 3, keep_spaces: bool = False) -> Column:
    """Contiguous character n-grams; a shorter text is its own gram, an empty one has none."""
    whole = text if keep_spaces else F.regexp_replace(text, WS, "")

    def grams(chars):
        at = F.sequence(F.lit(1), F.greatest(F.size(chars) - (size - 1), F.lit(1)))
        return F.when(F.size(chars) > 0, F.transform(at, lambda i: F.array_join(F.slice(chars, i, size), "")))

    # an array of characters: substring would walk the text from its start for each gram
    return F.coalesce(let(F.filter(F.split(whole, ""), lambda c: c != ""), grams), F.array().cast("array<string>"))


def char_ngram_sizes(text: Column, size: int = 3) -> Column:
    """Struct (n_grams, n_distinct): how many grams ``char_ngrams`` gives, and how many different ones, counted without an array of them."""

    def run(texts: pd.Series) -> pd.DataFrame:
        rows = [(n := max(len(t) - size + 1, min(len(t), 1)), len({t[i : i + size] for i in range(n)})) for t in texts]
        return pd.DataFrame(rows, columns=["n_grams", "n_distinct"])

    return F.pandas_udf(run, "n_grams int, n_distinct int")(F.coalesce(F.regexp_replace(text, WS, ""), F.lit("")))


def word_ngrams(text: Column, size: int = 2) -> Column:
    """Contiguous n-grams of lower-case words without punctuation; shorter texts are one gram."""

    def grams(w):
        at = F.sequence(F.lit(1), F.greatest(F.size(w) - (size - 1), F.lit(1)))
        return F.when(F.size(w) > 0, F.transform(at, lambda i: F.array_join(F.slice(w, i, size), " ")))

    plain = words(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}_ \\t\\n\\r\\f\\x0B]", " "))
    return F.coalesce(let(plain, grams), F.array().cast("array<string>"))


def evidence_form(text: Column) -> Column:
    """Tags and markdown decoration to spaces, blanks collapsed, lower case."""
    plain = F.regexp_replace(F.regexp_replace(text, "<[^>]*>", " "), "[*_`#>|~]+", " ")
    return F.lower(flat(plain))


def question_key(text: Column) -> Column:
    """Key by which questions are duplicates: evidence form without punctuation and blanks."""
    return F.regexp_replace(evidence_form(text), "[^\\p{L}\\p{N}]+", "")


def english_stem(word: Column) -> Column:
    """Plural endings of ASCII words: ies, ves, xes, ches, shes, s; at least two letters stay."""
    w = F.lower(word)

    def cut(ending: str, put: str) -> Column:
        return F.concat(F.substring(w, F.lit(1), F.length(w) - len(ending)), F.lit(put))

    rules = [("ies", "y"), ("ves", "f"), ("xes", "x"), ("ches", "ch"), ("shes", "sh"), ("s", "")]
    out = None
    for ending, put in rules:
        stem = cut(ending, put)
        fits = w.endswith(ending) & (F.length(stem) >= 2)
        out = F.when(fits, stem) if out is None else out.when(fits, stem)
    return F.when(w.rlike("^[a-z]+$"), out.otherwise(w)).otherwise(w)


#: Character classes by script.
SCRIPTS = {"latin": "[A-Za-zÀ-ɏ]", "hangul": "[가-힣]", "cyrillic": "[Ѐ-ӿ]", "han": "[一-鿿]", "thai": "[฀-๿]"}


def script_counts(text: Column) -> dict[str, Column]:
    """Characters of each script."""
    return {k: F.regexp_count(text, F.lit(v)) for k, v in SCRIPTS.items()}


def running_key(text: Column) -> Column:
    """A line without digits and blanks, by which page headers are compared."""
    return F.regexp_replace(text, "[0-9 \\t\\n\\r\\f\\x0B]+", "")


def safe_stem(title: Column, default: str = "document", limit: int = 80) -> Column:
    """A title as a file name stem."""
    stem = F.trim(F.regexp_replace(F.regexp_replace(title, '[\\\\/:*?"<>|]+', " "), WS, " "))
    return F.coalesce(F.nullif(F.substring(stem, 1, limit), F.lit("")), F.lit(default))


def markdown_bytes(text: Column) -> Column:
    """Markdown for office programs: a byte-order mark and CRLF line ends."""
    return F.concat(F.lit("﻿"), F.regexp_replace(F.regexp_replace(text, "\r\n", "\n"), "\n", "\r\n"))
