"""Statutes made of a user's events: kinds of events are articles, events are paragraphs with a mark of change, some are addenda."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import revisions
from .registry import query, table

EVENTS = """WITH e AS (SELECT user_id, event_id, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'error' THEN 3 WHEN 'purchase' THEN 4 ELSE 5 END AS article,
  DATE '1990-01-01' + (event_id * 37 % 9000)::INT AS day, event_id % 6 AS act FROM events)"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.try_element_at(F.create_map(*[F.lit(x) for kv in {"view": 1, "click": 2, "error": 3, "purchase": 4}.items() for x in kv]), F.col("event_type"))
    day = F.date_add(F.lit("1990-01-01").cast("date"), (F.col("event_id") * 37 % 9000).cast("int"))
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.coalesce(number, F.lit(5)).alias("article"), day.alias("day"), (F.col("event_id") % 6).alias("act"))


def _statutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, pos, level, path, text, event_id): a history, five articles with a paragraph an event, and addenda for each seventh event."""
    e = _events(spark, sf_dir)
    said = lambda day: F.concat(F.year(day).cast("string"), F.lit(". "), F.month(day).cast("string"), F.lit(". "), F.dayofmonth(day).cast("string"), F.lit("."))
    korean = lambda day: F.concat(F.year(day).cast("string"), F.lit("년 "), F.month(day).cast("string"), F.lit("월 "), F.dayofmonth(day).cast("string"), F.lit("일"))
    block = lambda pos, level, path, text, event: F.struct(pos.cast("string").alias("pos"), F.lit(level).cast("int").alias("level"), path.cast("string").alias("path"), text.alias("text"), event.cast("long").alias("event_id"))
    none = F.lit(None)
    history = e.groupBy("user_id").agg(F.min("day").alias("day")).select("user_id", block(F.lit("0"), None, none, F.concat(F.lit("제정 "), said(F.col("day"))), none).alias("b"))
    place = F.concat(F.lit("1"), F.col("article").cast("string"))
    path = F.concat(F.lit("제"), F.col("article").cast("string"), F.lit("조(목적)"))
    articles = e.select("user_id", "article").distinct().select("user_id", block(place, 5, path, path, none).alias("b"))
    mark = F.when(F.col("act") == 0, F.concat(F.lit("<삭제 "), said(F.col("day")), F.lit(">"))).when(F.col("act") == 1, F.concat(F.lit("[본조신설 "), korean(F.col("day")), F.lit("]"))).when(F.col("act") == 2, F.concat(F.lit("(항 신설 "), said(F.col("day")), F.lit(")"))).when(F.col("act") == 3, F.lit("")).otherwise(F.concat(F.lit("<개정 "), said(F.col("day")), F.lit(">")))
    paragraph = block(F.concat(place, F.lit("1"), F.lpad(F.col("event_id").cast("string"), 12, "0")), None, none, F.concat(F.lit("내용 "), mark), F.col("event_id"))
    at = F.concat(F.lit("2"), F.lpad(F.col("event_id").cast("string"), 12, "0"))
    head = block(at, 2, none, F.concat(F.lit("부칙 <"), said(F.col("day")), F.lit(">")), none)
    later = F.date_add("day", 10)
    other = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" 다만, 제2조의 규정은 "), korean(F.date_add("day", 20)), F.lit("부터 시행한다."))).otherwise("")
    body = block(F.concat(at, F.lit("1")), None, none, F.concat(F.lit("이 규정은 "), korean(later), F.lit("부터 시행한다."), other), none)
    rows = e.select("user_id", F.explode(F.when(F.col("event_id") % 7 == 0, F.array(paragraph, head, body)).otherwise(F.array(paragraph))).alias("b"))
    return history.unionByName(articles).unionByName(rows).select("user_id", "b.*")


@query(EVENTS + """,
b AS (SELECT user_id, min(day) AS day FROM e GROUP BY user_id),
w AS (SELECT DISTINCT user_id, article, day FROM e WHERE act = 1),
m AS (SELECT user_id, event_id, day, CASE act WHEN 0 THEN '삭제' WHEN 2 THEN '신설' ELSE '개정' END AS kind FROM e WHERE act NOT IN (1, 3)
  UNION ALL SELECT e.user_id, event_id, w.day, '신설' FROM e JOIN w USING (user_id, article) UNION ALL SELECT e.user_id, event_id, b.day, '제정' FROM e JOIN b USING (user_id)),
l AS (SELECT user_id, event_id, max(day) AS day FROM m GROUP BY ALL),
k AS (SELECT l.user_id, l.event_id, l.day, coalesce(min(kind) FILTER (kind NOT IN ('개정', '삭제')), '개정') AS label, bool_or(kind = '삭제') AS gone FROM l JOIN m USING (user_id, event_id, day) GROUP BY ALL),
a AS (SELECT user_id, event_id AS i, day, day + 10 AS force, CASE WHEN event_id % 3 = 0 THEN day + 20 END AS other FROM e WHERE event_id % 7 = 0),
p AS (SELECT user_id, day, max(i) AS i FROM a GROUP BY ALL),
n AS (SELECT k.user_id, k.event_id, arg_min(a.i, a.force - DATE '1990-01-01' + a.i / 1e9) AS i FROM k JOIN a ON k.user_id = a.user_id AND a.force >= k.day GROUP BY ALL),
z AS (SELECT user_id, max(i) AS i FROM a GROUP BY user_id),
f AS (SELECT k.*, e.article, coalesce(p.i, n.i, z.i) AS i FROM k JOIN e USING (user_id, event_id) LEFT JOIN p ON p.user_id = k.user_id AND p.day = k.day LEFT JOIN n ON n.user_id = k.user_id AND n.event_id = k.event_id LEFT JOIN z ON z.user_id = k.user_id)
SELECT f.user_id, f.event_id, label, strftime(f.day, '%Y-%m-%d') AS date, strftime(CASE WHEN f.article = 2 AND other IS NOT NULL THEN other ELSE force END, '%Y-%m-%d') AS effective, CASE WHEN gone THEN strftime(f.day, '%Y-%m-%d') END AS deleted
FROM f LEFT JOIN a ON a.user_id = f.user_id AND a.i = f.i""")
def article_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last change of every paragraph of every user's statute, and when it came into force."""
    rows = revisions.annotate_revisions(_statutes(spark, sf_dir), "user_id", "pos")
    return rows.where("event_id IS NOT NULL").select("user_id", "event_id", "revision.*")


@query(EVENTS + """,
d AS (SELECT user_id, article, day, coalesce(min(CASE act WHEN 1 THEN '신설' WHEN 2 THEN '전문개정' END), '개정') AS label, bool_or(act = 0) AS gone FROM e GROUP BY ALL)
SELECT user_id, article, label, day::VARCHAR AS valid_from, (CASE WHEN gone THEN day ELSE lead(day) OVER (PARTITION BY user_id, article ORDER BY day) END)::VARCHAR AS valid_to FROM d""")
def article_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The time each version of every article holds."""
    kind = F.when(F.col("act") == 0, revisions.DELETED).when(F.col("act") == 1, revisions.NEW).when(F.col("act") == 2, revisions.REWRITTEN).otherwise(revisions.AMENDED)
    marks = _events(spark, sf_dir).select(F.struct("user_id", "article").alias("key"), "day", kind.alias("kind"))
    return revisions.versions(marks, "key", "day", "kind").select("key.user_id", "key.article", "label", F.col("valid_from").cast("string").alias("valid_from"), F.col("valid_to").cast("string").alias("valid_to"))
