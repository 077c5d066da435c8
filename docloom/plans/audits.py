"""Queries of personal data, facts, directions, Markdown, changes and suites."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.suites import METRICS, TARGETS
from .registry import query, table
from .turns import TURN_PAIRS, turn_pairs


def _value(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, str):
        return "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    return f"{x}::DOUBLE" if isinstance(x, float) else f"{x}"


def values(rows: list[tuple], names: str) -> str:
    """A table of rows in SQL."""
    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(_value, r)) + ")" for r in rows) + f") v({names}))"


@query()
def personal_data_places(spark, sf_dir):
    from ..operators.pii import audit

    return audit(table(spark, sf_dir, "documents"), "doc_id", "text")


@query()
def personal_data_leaks(spark, sf_dir):
    from ..operators.pii import leaks

    return leaks(table(spark, sf_dir, "documents"), "text")


_DATE = "[0-9]{4}[-./][0-9]{1,2}[-./][0-9]{1,2}|[0-9]{4}년 ?[0-9]{1,2}월 ?[0-9]{1,2}일|[0-9]{4}년 ?[0-9]{1,2}월|[0-9]{1,2}월 ?[0-9]{1,2}일"
_UNITS = "퍼센트|만원|억원|천원|개월|시간|달러|원|건|명|개|일|주|년|월|분|초|평|%|㎡"


#: RE2 knows no boundary of words beyond ASCII: what stands around a name is matched with it, so blanks are doubled first.
_NAMES = "regexp_extract_all(regexp_replace({0}, '([^\\p{{L}}\\p{{N}}_&.-])', '\\1\\1', 'g'), '(?:^|[^\\p{{L}}\\p{{N}}_])([A-Z][A-Za-z0-9&.-]*[A-Za-z0-9])(?:[^\\p{{L}}\\p{{N}}_]|$)', 1)"


def _facts_sql(key: str) -> str:
    """(key, kind, item, d) of (key, side, t): facts with 1 left and -1 right."""
    date = "list_transform(regexp_extract_all(x, '[0-9]+'), lambda p: lpad(p, 2, '0'))"
    return f"""body AS (SELECT {key}, side, t, regexp_replace(t, '{_DATE}', ' ', 'g') AS b FROM sides),
  found AS (SELECT {key}, side, 'numbers' AS kind, replace(unnest(regexp_extract_all(b, '[-+]?[0-9]{{1,3}}(?:,[0-9]{{3}})+(?:\\.[0-9]+)?|[-+]?[0-9]+(?:\\.[0-9]+)?')), ',', '') AS item FROM body
    UNION ALL SELECT {key}, side, 'dates', array_to_string({date}, '-') FROM (SELECT {key}, side, unnest(regexp_extract_all(t, '{_DATE}')) AS x FROM body)
    UNION ALL SELECT {key}, side, 'units', unnest(regexp_extract_all(regexp_replace(b, '([0-9\\s])', '\\1\\1', 'g'), '[0-9\\s]({_UNITS}|(?:USD|KRW|kg|km|cm|mm|g|t|m)(?:[^A-Za-z]|$))', 1)) FROM body
    UNION ALL SELECT {key}, side, 'entities', unnest(list_distinct({_NAMES.format('t')})) FROM body),
  diff AS (SELECT {key}, kind, item, sum(side) AS d FROM (SELECT {key}, side, kind, CASE WHEN kind = 'units' THEN regexp_replace(item, '^(USD|KRW|kg|km|cm|mm|g|t|m).$', '\\1') ELSE item END AS item FROM found) GROUP BY ALL HAVING sum(side) <> 0)"""


@query(f"""WITH {TURN_PAIRS}, sides AS (SELECT pair, 1 AS side, a AS t FROM pairs UNION ALL SELECT pair, -1, b FROM pairs), {_facts_sql('pair')},
  n AS (SELECT pair, {', '.join(f"coalesce(sum(abs(d)) FILTER (kind = '{k}'), 0)::BIGINT AS {k}" for k in ('numbers', 'dates', 'units', 'entities'))} FROM pairs LEFT JOIN diff USING (pair) GROUP BY pair)
  SELECT *, numbers + dates + units + entities = 0 AS passed FROM n""")
def turn_fact_check(spark, sf_dir):
    from ..operators.facts import cross_check

    return cross_check(turn_pairs(spark, sf_dir), "pair", "a", "b")


@query(f"WITH p AS (SELECT len({_NAMES.format('text')}) > 0 AS ok FROM documents) SELECT count(*) AS items, count(ok) AS scored, round(count(*) FILTER (ok) / nullif(count(ok), 0), 4)::DOUBLE AS pass_rate FROM p")
def named_pass_rate(spark, sf_dir):
    from ..operators.facts import extract_entities
    from ..operators.suites import pass_rate

    return pass_rate(table(spark, sf_dir, "documents"), F.size(extract_entities(F.col("text"))) > 0)


@query(f"""WITH {TURN_PAIRS} SELECT count(*) AS items, count(nullif(length(b), 0)) AS measurable, round(avg(nullif(length(b), 0)), 4)::DOUBLE AS mean, min(nullif(length(b), 0))::INT AS least, max(nullif(length(b), 0))::INT AS most FROM pairs""")
def turn_answer_lengths(spark, sf_dir):
    from ..operators.suites import mean_of

    return mean_of(turn_pairs(spark, sf_dir), F.nullif(F.length("b"), F.lit(0)))


def _share(text, code):
    from ..functions.language import LETTERS

    letters = lambda k: F.regexp_count(text, F.lit(LETTERS[k]))
    every = letters("ko") + letters("en") + letters("zh") + letters("th") + letters("ru")
    own = F.lit(None).cast("int")
    for k in LETTERS:
        own = F.when(code == k, letters(k)).otherwise(own)
    return F.coalesce(own / F.nullif(every, F.lit(0)), F.lit(0.0))


@query("""SELECT doc_id, CASE WHEN nullif(trim(coalesce(lang, '')), '') IS NOT NULL AND lang NOT IN ('ko', 'en', 'zh', 'th', 'vi', 'ru') THEN 'unknown_language'
  WHEN lang = 'ko' OR (nullif(trim(coalesce(lang, '')), '') IS NULL AND length(regexp_replace(text, '[^가-힣]', '', 'g')) > length(regexp_replace(text, '[^\\p{Latin}]', '', 'g'))) THEN 'same_language' ELSE 'ok' END AS verdict FROM documents""")
def document_directions(spark, sf_dir):
    from ..operators.directions import resolve_direction

    found = resolve_direction(F.lit("ko"), F.col("lang"), F.col("text"), _share)
    return table(spark, sf_dir, "documents").select("doc_id", found["verdict"].alias("verdict"))


@query("SELECT doc_id, md5(coalesce(text, '')) AS form FROM documents")
def markdown_round_trip(spark, sf_dir):
    from ..operators.markdown import rebuild, split_units

    cut = split_units(table(spark, sf_dir, "documents").repartition("doc_id"), "doc_id", "text")
    none = cut.select("doc_id", "unit", F.lit(None).cast("string").alias("translated")).where("false")
    return rebuild(cut, none, "doc_id").select("doc_id", F.md5("text").alias("form"))


@query("SELECT page_id, md5(coalesce(html, '')) AS form FROM pages")
def markdown_page_round_trip(spark, sf_dir):
    from ..operators.markdown import rebuild, split_units

    cut = split_units(table(spark, sf_dir, "pages").repartition("page_id"), "page_id", "html")
    none = cut.select("page_id", "unit", F.lit(None).cast("string").alias("translated")).where("false")
    return rebuild(cut, none, "page_id").select("page_id", F.md5("text").alias("form"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
  c AS (SELECT *, regexp_matches(x, '^\\s*(?:```|~~~)') AS f, sum(regexp_matches(x, '^\\s*(?:```|~~~)')::INT) OVER (PARTITION BY doc_id ORDER BY i) % 2 = 1 AS o FROM l),
  b AS (SELECT *, NOT f AND NOT o AS body FROM c)
  SELECT doc_id, count(*) FILTER (body AND regexp_matches(trim(x), '^#{1,6}\\s')) AS n_headings, count(*) FILTER (body AND regexp_matches(x, '^\\s*\\|')) AS n_rows, count(*) FILTER (f) AS fences FROM b GROUP BY doc_id""")
def markdown_structure(spark, sf_dir):
    from ..operators.markdown import structure

    out = structure(table(spark, sf_dir, "documents"), "doc_id", "text")
    return out.select("doc_id", F.size("headings").cast("long").alias("n_headings"), (F.size("table_rows") + F.col("separator_rows")).alias("n_rows"), "fences")


@query()
def turn_changes(spark, sf_dir):
    from ..operators.changes import change_list

    return change_list(turn_pairs(spark, sf_dir), "pair", "a", "b").select("pair", F.size("changes").alias("n_changes"))


_MEASURED = """WITH d AS (SELECT source, avg((n_chars > 100)::INT) AS long, avg((text LIKE '%***%')::INT) AS odd, count(DISTINCT lang) AS n FROM documents GROUP BY source),
  m AS (SELECT source AS run, 'faq' AS feature, 'faq_generation_health.yield_rate' AS path, long AS actual FROM d UNION ALL SELECT source, 'faq', 'faq_generation_health.rejection_rates.schema', odd FROM d
    UNION ALL SELECT source, 'faq', 'pii_leak_count.leak_count', CASE WHEN n > 3 THEN 0 END FROM d)"""


def _measured(spark, sf_dir):
    d = table(spark, sf_dir, "documents").groupBy("source").agg(
        F.avg((F.col("n_chars") > 100).cast("int")).alias("long"), F.avg(F.col("text").contains("***").cast("int")).alias("odd"), F.count_distinct("lang").alias("n")
    )
    leaks = F.when(F.col("n") > 3, 0.0)
    rows = F.array(*[F.struct(F.lit(p).alias("path"), v.cast("double").alias("actual")) for p, v in (
        ("faq_generation_health.yield_rate", F.col("long")), ("faq_generation_health.rejection_rates.schema", F.col("odd")), ("pii_leak_count.leak_count", leaks),
    )])
    return d.select(F.col("source").alias("run"), F.lit("faq").alias("feature"), F.inline(rows))


_CHECKS = _MEASURED + f""", t AS {values(TARGETS, 'feature, path, operator, value')},
  c AS (SELECT run, feature, path, CASE WHEN actual IS NULL THEN 'not_measured' WHEN CASE operator WHEN 'eq' THEN actual = value WHEN 'gt' THEN actual > value ELSE actual < value END THEN 'pass' ELSE 'fail' END AS status
    FROM (SELECT DISTINCT run, feature FROM m) JOIN t USING (feature) LEFT JOIN m USING (run, feature, path))"""


@query(_CHECKS + " SELECT * FROM c")
def suite_checks(spark, sf_dir):
    from ..operators.suites import check_targets, targets

    return check_targets(_measured(spark, sf_dir), targets(spark)).select("run", "feature", "path", "status")


@query(_CHECKS + """ SELECT run, feature, CASE WHEN count(*) FILTER (status = 'fail') > 0 THEN 'fail' WHEN count(*) FILTER (status = 'pass') = 0 THEN 'not_measured' WHEN count(*) FILTER (status = 'not_measured') > 0 THEN 'pass_but_incomplete'
    ELSE 'pass' END AS verdict, count(*) FILTER (status = 'pass') AS n_passed, count(*) FILTER (status = 'fail') AS n_failed, count(*) FILTER (status = 'not_measured') AS n_not_measured FROM c GROUP BY run, feature""")
def suite_reports(spark, sf_dir):
    from ..operators.suites import check_targets, targets, verdicts

    return verdicts(check_targets(_measured(spark, sf_dir), targets(spark)))


@query("""WITH g AS (SELECT doc_id, n_chars >= 200 AS ok, CASE WHEN doc_id % 3 > 0 THEN (doc_id % 10) / 10 END AS sim FROM documents),
  r AS (SELECT doc_id, CASE WHEN NOT coalesce(ok, false) THEN 'deterministic_failed' WHEN sim IS NULL THEN 'deterministic_passed' WHEN sim >= 0.8 THEN 'embedding_passed' ELSE 'low_similarity' END AS reason FROM g)
  SELECT doc_id, CASE WHEN reason IN ('deterministic_failed', 'low_similarity') THEN 'candidate' ELSE 'screened_out' END AS outcome, reason,
    reason IN ('deterministic_failed', 'low_similarity') AND ('0x' || substr(sha256('gate:' || doc_id::VARCHAR), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616 < 0.1 AS judged FROM r""")
def gated_documents(spark, sf_dir):
    from ..operators.suites import gate

    similarity = F.when(F.col("doc_id") % 3 > 0, (F.col("doc_id") % 10) / 10)
    return gate(table(spark, sf_dir, "documents"), "doc_id", F.col("n_chars") >= 200, similarity, True)
