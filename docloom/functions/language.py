"""Scripts, languages, and word forms of Korean and English, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import english_stem, let

# The letters that tell Vietnamese from other Latin script, and the code blocks of the other scripts.
VIETNAMESE = "ăâđêôơưĂÂĐÊÔƠƯáàảãạắằẳẵặấầẩẫậéèẻẽẹếềểễệíìỉĩịóòỏõọốồổỗộớờởỡợúùủũụứừửữựýỳỷỹỵ"
LETTERS = {
    "ko": "[\\uAC00-\\uD7A3\\u1100-\\u11FF\\u3130-\\u318F]",
    "th": "[\\u0E00-\\u0E7F]",
    "ru": "[\\u0400-\\u052F]",
    "zh": "[\\u4E00-\\u9FFF\\u3400-\\u4DBF\\uF900-\\uFAFF]",
    "en": "\\p{IsLatin}",
    "vi": f"[{VIETNAMESE}]",
}

# Korean particles, longest first, and the endings of two auxiliary verbs.
PARTICLES = "에게서 으로는 에서는 이라고 라고는 에게 에서 으로 이라 라고 부터 까지 마다 조차 처럼 만큼 밖에 이나 이란 로서 로써 한테 보다 대로 께서 이며 이고 은 는 이 가 을 를 의 에 와 과 도 만 로 랑 야 아 나"
ENDINGS = {
    "하": "다 는 여 여야 면 고 지 며 기 게 던 므로 셨다면 셨습니다 신 실 세요 십시오 였다 였고 였으며 였습니다 였던",
    "되": "다 는 어 어야 어서 어도 면 고 지 며 기 게 던 므로 셨다면 신 었다 었고 었으며 었습니다 었던 었으나",
    "": "한다 한 할 함 합니다 해 해야 해서 해도 했다 했고 했으며 했습니다 했던 했으나 된다 된 될 됨 됩니다 돼 돼야 돼서 됐다 됐고 됐으며 됐습니다 됐던 됐으나",
}

# One token is a run of one script's letters, a run of digits, or one punctuation mark.
TOKEN = "[A-Za-zÀ-ɏ]+|[가-힣]+|[Ѐ-ԯ]+|[一-鿿]+|[฀-๿]+|[0-9]+|[,，、;；:：.。!！?？/／|｜·ㆍ・•‧()（）\\[\\]{}「」『』《》〈〉…]"
# Marks that count as the same.
MARKS, SAME_MARKS = "，、；：。！？／｜ㆍ・•‧（）「」『』《》〈〉{}", ",,;:.!?/|····()[][]<><>()"
# Particle pairs, after a final consonant and after none; the first of those also after none but ㄹ.
AGREEING = {"을": "를", "이": "가", "은": "는", "과": "와", "으로": "로", "으로써": "로써", "이라": "라"}


def detect(text: Column, sample: int | None = None) -> Column:
    """Struct (code, share): the language with the most letters of its script, in the first ``sample`` characters if given.

    Latin letters are Vietnamese if any of them is marked so, else English. On
    ties the script met first stands, Vietnamese last. A text without letters,
    or null, gives ('', 0).
    """
    none = F.struct(F.lit("").alias("code"), F.lit(0.0).alias("share"))

    def count(head: Column) -> Column:
        # a class of many single letters is slow, so it meets only what two ranges leave over; and none but Latin has letters in ASCII
        wide = F.struct(F.regexp_replace(head, "[\\x00-\\x7F]+", "").alias("wide"), F.regexp_replace(head, "[^\\u00C0-\\u024F\\u1E00-\\u1EFF]+", "").alias("vi"))
        of = lambda w, k: head if k == "en" else w["vi"] if k == "vi" else w["wide"]
        return let(wide, lambda w: F.struct(head.alias("head"), *[F.length(F.regexp_replace(of(w, k), f"[^{c.strip('[]')}]+", "")).alias(k) for k, c in LETTERS.items()]))

    def pick(c: Column) -> Column:
        marked = c["vi"] > 0
        n = {k: c[k] for k in LETTERS} | {"vi": F.when(marked, c["en"]).otherwise(0), "en": F.when(marked, 0).otherwise(c["en"])}
        place = {k: -F.length(c["head"]) - 1 if k == "vi" else -F.regexp_instr(c["head"], F.lit(shape)) for k, shape in LETTERS.items()}
        top = F.array_max(F.array(*[F.struct(n[k].alias("n"), F.when(n[k] > 0, place[k]).alias("place"), F.lit(k).alias("code")) for k in LETTERS]))
        return F.when(sum(n.values(), F.lit(0)) > 0, F.struct(top["code"].alias("code"), F.round(top["n"] / sum(n.values(), F.lit(0)), 4).alias("share")))

    return F.coalesce(let(let(text if sample is None else F.substring(text, 1, sample), count), pick), none)


def strip_particle(word: Column, least: int = 2) -> Column:
    """A Hangul word without the longest particle at its end; ``least`` letters stay."""
    return F.regexp_replace(word, f"^([가-힣]{{{least},}}?)(?:{'|'.join(PARTICLES.split())})$", "$1")


def strip_ending(word: Column) -> Column:
    """A Hangul word without an auxiliary verb's ending; two letters stay."""
    tails = "|".join(stem + e for stem, ends in ENDINGS.items() for e in ends.split())
    return F.regexp_replace(word, f"^([가-힣]{{2,}}?)(?:{tails})$", "$1")


def verb_stems(word: Column) -> Column:
    """What an English -ied, -ed or -ing form may come from: bare, with e, with one of two equal consonants."""
    ied = F.regexp_extract(word, "^([a-z]{2,})ied$", 1)
    stem = F.regexp_extract(word, "^([a-z]{3,})(?:ed|ing)$", 1)
    single = F.regexp_extract(stem, "^(.*([^aeiou]))\\2$", 1)
    other = F.when(stem != "", F.array(stem, F.concat(stem, F.lit("e")), F.nullif(single, F.lit("")))).otherwise(F.array().cast("array<string>"))
    return F.array_compact(F.when(ied != "", F.array(F.concat(ied, F.lit("y")))).otherwise(other))


def is_mark(token: Column) -> Column:
    return ~token.rlike("[\\p{L}\\p{N}\\p{M}]")


def raw_tokens(text: Column) -> Column:
    """Script runs, numbers and marks of a text in order, as they stand."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def plain(token: Column) -> Column:
    """A token in lower case, an ASCII word in singular, a mark in one form."""
    return F.translate(english_stem(token), MARKS, SAME_MARKS)


def tokens(text: Column) -> Column:
    return F.transform(raw_tokens(text), plain)


def final_consonant(word: Column) -> Column:
    """Number of the last syllable's final consonant (0: none, 8: ㄹ); null if it isn't a Hangul syllable."""
    code = F.conv(F.hex(F.encode(F.right(word, F.lit(1)), "UTF-16BE")), 16, 10).cast("int")
    return F.when(code.between(0xAC00, 0xD7A3), (code - 0xAC00) % 28)


def particle_check(word: Column) -> Column:
    """Struct (stem, used, expected) of a word with an agreeing particle at its end; null without one."""
    body = F.regexp_replace(word, "^[\\s.,!?…:;)\\]}\"'’”」』〉》]+|[\\s.,!?…:;)\\]}\"'’”」』〉》]+$", "")
    forms = sorted({*AGREEING, *AGREEING.values()}, key=lambda p: (-len(p), p))
    shape = f"^(.+?)({'|'.join(forms)})$"
    stem, used = F.regexp_extract(body, shape, 1), F.regexp_extract(body, shape, 2)
    final = F.coalesce(final_consonant(stem), F.lit(0))
    want = None
    for closed, open_ in AGREEING.items():
        right = F.when((final == 0) | ((final == 8) & F.lit(closed in ("으로", "으로써"))), open_).otherwise(closed)
        want = (F.when if want is None else want.when)(used.isin(closed, open_), right)
    return F.when(used != "", F.struct(stem.alias("stem"), used.alias("used"), want.alias("expected")))
