"""Revisions of statutes: marks of change in articles, addenda that bring them into force, and the time each version holds."""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import scan
from .outline import ARTICLE
from .tables import _beside

# How dates, histories, marks and addenda are written, and the names of revisions.
DATE = "\\d{4}\\s*(?:\\.|년)\\s*\\d{1,2}\\s*(?:\\.|월)\\s*\\d{1,2}\\s*(?:\\.|일)?"
DATE_PARTS = "(\\d{4})\\s*(?:\\.|년)\\s*(\\d{1,2})\\s*(?:\\.|월)\\s*(\\d{1,2})"
HISTORY = f"(제\\s*정|전\\s*면\\s*개\\s*정|전\\s*부\\s*개\\s*정|일\\s*부\\s*개\\s*정|개\\s*정)\\s*({DATE})"
HISTORY_TAIL = f"({DATE})\\s*,\\s*(제정|전부개정|전면개정|일부개정)\\s*\\]"
MARK = f"[(<\\[]\\s*(본조|전문|제목|조|항|호|목)?\\s*(개정|신설|삭제)\\s*((?:{DATE}\\s*,?\\s*)+)[)>\\]]"
IN_FORCE = f"({DATE})\\s*(?:일)?\\s*부터\\s*시행"
ON_PROMULGATION = "(?:공포|발령)\\s*(?:한\\s*날|일)\\s*부터\\s*시행"
PROVISO = f"(?s)다만\\s*,?(.{{0,200}}?)({DATE})\\s*(?:일)?\\s*부터\\s*시행"
ARTICLE_NUMBER = "제\\s*(\\d+)\\s*조"
ADDENDA_HEAD = "^부\\s*칙(?=[\\s(<\\[]|$)"
NEW, AMENDED, DELETED, REWRITTEN = "신설", "개정", "삭제", "전문개정"
BASES = ("제정", "전면개정", "전부개정")
STAMP = ("일 ", ", 시행일 ", "년 ", "월 ", "일")

MARKS = "array<struct<date:string,kind:string>>"


def parse_date(text: Column) -> Column:
    """The first date of a text as YYYY-MM-DD; null without one, or where month or day is out of range."""
    part = lambda i: F.regexp_extract(text, DATE_PARTS, i)
    month, day = F.nullif(part(2), F.lit("")).cast("int"), F.nullif(part(3), F.lit("")).cast("int")
    return F.when(month.between(1, 12) & day.between(1, 31), F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0")))


def written_date(date: Column) -> Column:
    """YYYY-MM-DD as a date is written in Korean."""
    part = lambda a, n: F.substring(date, a, n).cast("int").cast("string")
    return F.concat(part(1, 4), F.lit(STAMP[2]), part(6, 2), F.lit(STAMP[3]), part(9, 2), F.lit(STAMP[4]))


def _dated(kind: Column, date: Column) -> Column:
    return F.struct(parse_date(date).alias("date"), kind.alias("kind"))


def history_marks(text: Column) -> Column:
    """Array of (date, kind) from a statute's history, in either order of writing."""
    head = F.transform(F.regexp_extract_all(text, F.lit(HISTORY), F.lit(0)), lambda x: _dated(F.regexp_replace(F.regexp_extract(x, HISTORY, 1), "\\s+", ""), F.regexp_extract(x, HISTORY, 2)))
    tail = F.transform(F.regexp_extract_all(text, F.lit(HISTORY_TAIL), F.lit(0)), lambda x: _dated(F.regexp_extract(x, HISTORY_TAIL, 2), F.regexp_extract(x, HISTORY_TAIL, 1)))
    return F.filter(F.concat(head, tail), lambda m: m["date"].isNotNull())


def change_marks(text: Column) -> Column:
    """Array of (date, kind, whole): marks of change in a text; ``whole`` tells those that speak of the article and not of this part of it."""
    def of(x: Column) -> Column:
        scope, action = F.regexp_extract(x, MARK, 1), F.regexp_extract(x, MARK, 2)
        whole = F.when((scope == "본조") & (action == NEW), NEW).when((scope == "전문") & (action == AMENDED), REWRITTEN)
        dates = F.regexp_extract_all(F.regexp_extract(x, MARK, 3), F.lit(DATE), F.lit(0))
        return F.transform(dates, lambda d: F.struct(parse_date(d).alias("date"), F.coalesce(whole, action).alias("kind"), whole.isNotNull().alias("whole")))

    found = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(MARK), F.lit(0)), of))
    return F.filter(F.coalesce(found, F.array().cast("array<struct<date:string,kind:string,whole:boolean>>")), lambda m: m["date"].isNotNull())


def in_articles(blocks: DataFrame, doc: str, pos: str, level: str = "level", path: str = "path", text: str = "text") -> DataFrame:
    """``blocks`` with ``article`` (the article's path, null outside) and ``addendum`` (the position of the addendum's head, null outside).

    A heading of level 2 or higher opens an addendum if it says so, and else
    closes it; within one nothing opens an article. An article lasts to the next heading above it.
    """
    so_far = Window.partitionBy(doc).orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = F.coalesce(F.col(level), F.lit(0))
    top = at.between(1, 2)
    opens = F.trim(F.col(text)).rlike(ADDENDA_HEAD)
    rows = blocks.withColumn("_head", F.last(F.when(top, F.struct(F.col(pos).alias("pos"), opens.alias("opens"))), ignorenulls=True).over(so_far))
    rows = rows.withColumn("addendum", F.when(F.col("_head.opens"), F.col("_head.pos")))
    event = F.when(F.col("addendum").isNull() & at.between(1, ARTICLE), F.struct(F.when(at == ARTICLE, F.col(path)).alias("path")))
    inside = F.last(event, ignorenulls=True).over(so_far)["path"]
    return rows.withColumn("article", F.when(F.col("addendum").isNull(), inside)).drop("_head")


def read_addenda(blocks: DataFrame, doc: str, pos: str, text: str = "text") -> DataFrame:
    """(doc, i, date, effective, promulgated, exceptions): each addendum of ``in_articles``: the date in its head, when it brings the change into force, and other dates of single articles.

    ``exceptions`` maps an article's number to its date. One addendum's text comes together as one string.
    """
    rows = blocks.where("addendum IS NOT NULL")
    head = F.max(F.when(F.col(pos) == F.col("addendum"), F.regexp_replace(F.trim(text), ADDENDA_HEAD, "")))
    parts = F.sort_array(F.collect_list(F.when(F.col(pos) != F.col("addendum"), F.struct(F.col(pos).alias("p"), F.coalesce(text, F.lit("")).alias("t")))))
    whole = rows.groupBy(doc, F.col("addendum").alias("i")).agg(head.alias("_head"), F.array_join(F.transform(parts, lambda x: x["t"]), "\n").alias("_body"))
    main = F.regexp_replace("_body", PROVISO, " ")
    numbers = lambda x: F.transform(F.regexp_extract_all(F.regexp_extract(x, PROVISO, 1), F.lit(ARTICLE_NUMBER), F.lit(1)), lambda n: F.struct(n.cast("int").alias("n"), parse_date(F.regexp_extract(x, PROVISO, 2)).alias("date")))
    every = F.filter(F.flatten(F.transform(F.regexp_extract_all("_body", F.lit(PROVISO), F.lit(0)), numbers)), lambda x: x["date"].isNotNull())
    return whole.select(
        doc, "i", parse_date(F.col("_head")).alias("date"), parse_date(F.regexp_extract(main, IN_FORCE, 1)).alias("effective"),
        main.rlike(ON_PROMULGATION).alias("promulgated"), every.alias("exceptions"),
    )


def _pair(state: tuple, is_addendum: bool, date: str | None, effective: str | None) -> tuple:
    """An addendum's revision: the one that its head names, or the latest up to its effective date that is later than the last one taken and free."""
    dates, taken, last = state
    if not is_addendum:
        if date is not None and (not dates or dates[-1] != date):
            dates.append(date)
        return state, None
    if date is None and effective is not None:
        for d in reversed(dates[: bisect_right(dates, effective)]):
            if last is not None and d <= last:
                break
            if d not in taken:
                date = d
                break
    if date is not None:
        taken.add(date)
        last = date
    return (dates, taken, last), date


def pair_addenda(addenda: DataFrame, revisions: DataFrame, key: str) -> DataFrame:
    """(key, i, revision, effective): each addendum with the revision it brings into force.

    ``addenda`` has (key, i, date, effective), ``revisions`` (key, date). A
    key's revisions in order and then its addenda are streamed through one
    task, whose state is the revisions' distinct dates. Null keys are one; addenda that tie in
    ``i`` go by their dates; dates of any type that can be ordered will do.
    """
    kind = dict(addenda.dtypes)["date"]
    rows = addenda.select(key, "i", "date", "effective", F.lit(True).alias("_is"))
    both = revisions.select(key, F.lit(None).cast(dict(addenda.dtypes)["i"]).alias("i"), "date", F.lit(None).cast(kind).alias("effective"), F.lit(False).alias("_is")).unionByName(rows)
    # as texts that sort like the dates; whole numbers are moved above zero for that
    moved = F.lit(1 << 62)
    whole = kind in ("bigint", "int")
    shown = (lambda c: F.lpad((F.col(c) + moved).cast("string"), 20, "0")) if whole else (lambda c: F.col(c).cast("string"))
    read = (lambda c: (c.cast("bigint") - moved).cast(kind)) if whole else (lambda c: c.cast(kind))
    both = both.withColumns({"_d": shown("date"), "_e": shown("effective")})
    out = scan(both, [key], ["_is", "i", "_d", "_e"], "_revision", "string", lambda: ([], set(), None), _pair, ["_is", "_d", "_e"])
    return out.where("_is").select(key, "i", read(F.col("_revision")).alias("revision"), "effective")


def _in_force(needed: DataFrame, addenda: DataFrame, doc: str) -> DataFrame:
    """(doc, date, effective, exceptions): for each revision date the entry that brings it into force.

    That of the last addendum paired with it, else of the addendum whose date
    is the next at or after it, else of the document's last addendum.
    """
    entry = F.struct("effective", "exceptions")
    known = addenda.where("effective IS NOT NULL")
    paired = known.where("revision IS NOT NULL").groupBy(doc, F.col("revision").alias("date")).agg(F.max_by(entry, "i").alias("_paired"))
    last = known.groupBy(doc).agg(F.max_by(entry, "i").alias("_last"))
    # one sort of both sides from the latest date down; a date's own addenda come before the revision that asks, the first of them last
    typed = dict(known.select(entry.alias("e")).dtypes)["e"]
    ask = needed.select(doc, "date", F.lit(1).alias("_side"), F.lit(None).cast("long").alias("i"), F.lit(None).cast(typed).alias("_entry"))
    give = known.select(doc, F.col("effective").alias("date"), F.lit(0).alias("_side"), F.col("i").cast("long").alias("i"), entry.alias("_entry"))
    down = Window.partitionBy(doc).orderBy(F.desc("date"), "_side", F.desc("i")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    later = ask.unionByName(give).withColumn("_later", F.last("_entry", ignorenulls=True).over(down)).where("_side = 1").select(doc, "date", "_later")
    met = _beside(_beside(later, paired, [doc, "date"]), last, [doc])
    return met.select(doc, "date", F.coalesce("_paired", "_later", "_last").alias("_entry")).select(doc, "date", "_entry.effective", "_entry.exceptions")


def annotate_revisions(blocks: DataFrame, doc: str, pos: str, level: str = "level", path: str = "path", text: str = "text") -> DataFrame:
    """``blocks`` with ``revision`` (label, date, effective, deleted): the last change of each block of an article.

    ``blocks`` are a statute's paragraphs with the level of their heading (5: an
    article) and, of articles, their path, a string that begins with the article's
    mark. A block's changes are its own marks, those that speak of its whole article, and
    the statute's making or remaking in the history above the first article. The latest
    date counts; of several kinds on that date the wider name stands: not
    ``개정`` if there is another, and ``삭제`` only shows as ``deleted``.
    ``effective`` is when it came into force, by the addenda.

    Blocks outside articles and articles without any change have null. Windows
    only grow with the row; marks are summed by block and by article before anything is
    joined. Null documents are one, positions are a document's own. Blocks that are HTML are read without their tags.
    An empty table gives an empty one.
    """
    plain = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "<[A-Za-z/][^>]*>", " ")
    rows = in_articles(blocks.withColumn("_text", plain), doc, pos, level, path, "_text")
    first = rows.where(F.col(level) == ARTICLE).groupBy(doc).agg(F.min(pos).alias("_first"))
    before = _beside(rows.select(doc, pos, "_text"), first, [doc]).where(F.col("_first").isNull() | (F.col(pos) < F.col("_first")))
    history = before.select(doc, F.explode(history_marks(F.col("_text"))).alias("m")).select(doc, "m.date", "m.kind")
    base = history.where(F.col("kind").isin(*BASES)).groupBy(doc).agg(F.max(F.struct("date", "kind")).alias("_base"))
    held = rows.withColumn("_marks", F.when(F.col("article").isNotNull(), change_marks(F.col("_text"))))
    whole = held.select(doc, "article", F.explode("_marks").alias("m")).where("m.whole").groupBy(doc, "article").agg(F.collect_set(F.struct("m.date", "m.kind")).alias("_whole"))
    held = _beside(_beside(held, whole, [doc, "article"]), base, [doc])
    own = F.transform(F.filter("_marks", lambda m: ~m["whole"]), lambda m: F.struct(m["date"].alias("date"), m["kind"].alias("kind")))
    every = F.concat(own, F.coalesce("_whole", F.array().cast(MARKS)), F.coalesce(F.array_compact(F.array("_base")), F.array().cast(MARKS)))
    held = held.withColumn("_every", F.when(F.col("article").isNotNull(), every))
    latest = F.array_max(F.transform("_every", lambda m: m["date"]))
    kinds = F.array_sort(F.array_distinct(F.transform(F.filter("_every", lambda m: m["date"] == F.col("_date")), lambda m: m["kind"])))
    held = held.withColumn("_date", latest).withColumn("_kinds", kinds)
    label = F.coalesce(F.get(F.filter("_kinds", lambda k: ~k.isin(AMENDED, DELETED)), F.lit(0)), F.lit(AMENDED))
    addenda = read_addenda(rows, doc, pos, "_text")
    pairs = pair_addenda(addenda, history.select(doc, "date"), doc).select(doc, "i", "revision")
    addenda = _beside(addenda, pairs, [doc, "i"])
    addenda = addenda.withColumn("effective", F.coalesce("effective", F.when(F.col("promulgated"), F.col("revision"))))
    force = _in_force(held.where("_date IS NOT NULL").select(doc, F.col("_date").alias("date")).distinct(), addenda, doc).withColumnsRenamed({"date": "_date"})
    held = _beside(held, force, [doc, "_date"])
    number = F.nullif(F.regexp_extract(F.coalesce(F.col("article"), F.lit("")), f"^{ARTICLE_NUMBER}", 1), F.lit("")).cast("int")
    other = F.filter("exceptions", lambda x: x["n"] == number)
    effective = F.coalesce(F.get(other, F.size(other) - 1)["date"], F.col("effective"))
    revision = F.struct(label.alias("label"), F.col("_date").alias("date"), effective.alias("effective"), F.when(F.array_contains("_kinds", DELETED), F.col("_date")).alias("deleted"))
    return held.select(*[F.col(c) for c in blocks.columns], F.when(F.col("_date").isNotNull(), revision).alias("revision"))


def revision_fields(revision: Column) -> list[Column]:
    """Record fields of a revision: last_amended_date, valid_from, and valid_to: empty unless it was deleted; null without a revision."""
    last, start = written_date(revision["date"]), written_date(revision["effective"])
    end = F.when(revision.isNotNull(), F.coalesce(written_date(revision["deleted"]), F.lit("")))
    return [last.alias("last_amended_date"), start.alias("valid_from"), end.alias("valid_to")]


def stamp(text: Column, revision: Column) -> Column:
    """The text with its revision's dates below it, as search results carry no record fields."""
    dates = F.concat(revision["label"], F.lit(STAMP[0]), written_date(revision["date"]), F.coalesce(F.concat(F.lit(STAMP[1]), written_date(revision["effective"])), F.lit("")))
    return F.when(revision.isNull(), text).otherwise(F.concat(F.coalesce(text, F.lit("")), F.lit("\n\n("), dates, F.lit(")")))


def versions(marks: DataFrame, key: str, date: str, kind: str) -> DataFrame:
    """(key, label, valid_from, valid_to): the time each version of a key holds, without overlap.

    All marks of a date are one version, under the widest of their names. It
    holds from its date to the next version's, or without end (null). With a
    deletion among its marks it ends the day it begins, and nothing holds until the next.
    Marks without a date are left out; null keys are one; repeated marks count once.
    """
    name = F.min(F.when(~F.col(kind).isin(AMENDED, DELETED), F.col(kind)))
    days = marks.where(F.col(date).isNotNull()).groupBy(key, F.col(date).alias("valid_from")).agg(F.coalesce(name, F.lit(AMENDED)).alias("label"), F.max(F.col(kind) == DELETED).alias("_gone"))
    following = F.lead("valid_from").over(Window.partitionBy(key).orderBy("valid_from"))
    return days.select(key, "label", "valid_from", F.when(F.coalesce("_gone", F.lit(False)), F.col("valid_from")).otherwise(following).alias("valid_to"))
