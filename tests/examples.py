"""Examples over rows that are written here, as the driver's tables hold no such text; each has the SQL that states its result."""

from pyspark.sql import functions as F

from docloom.operators import templates
from docloom.operators.suites import METRICS, TARGETS
from docloom.plans.audits import _share, values

#: name: (function of a session and a folder that is not read, SQL)
EXAMPLES = {}


def query(sql):
    def add(f):
        EXAMPLES[f.__name__] = (f, sql)
        return f

    return add


PRIVATE = [
    ("rrn", "주민번호 900101-1234568 입니다"), ("bad rrn", "900101-1234567"), ("biz", "사업자 123-45-67891"), ("bad biz", "123-45-67890"),
    ("card", "카드 4111 1111 1111 1111."), ("bad card", "4111 1111 1111 1112"), ("phone", "전화 010-1234-5678, 02-123-4567"),
    ("tags", "010-<mark>1234</mark>-5678"), ("mail", "a.b@c-d.co.kr 와 x@y"), ("licence", "11-22-333333-44"), ("passport", "M12345678 AM12345678"),
    ("name", "김민준 대리와 남궁민수 씨"), ("no title", "김민준이 왔다"), ("title", "선생님 이사님 박사님"), ("masked", "010-****-5678 ******-*******"),
    ("in a run", "1900101-1234568 0123-45-678910"), ("none", ""), ("null", None),
]


@query("SELECT name, category, s::INT AS start, e::INT AS \"end\" FROM " + values([
    ("rrn", "rrn", 5, 19), ("biz", "biz", 4, 16), ("card", "card", 3, 22), ("phone", "phone", 3, 16), ("phone", "phone", 18, 29), ("tags", "phone", 0, 13),
    ("mail", "email", 0, 13), ("licence", "driver_license", 0, 15), ("passport", "passport", 0, 9), ("name", "name", 0, 3), ("name", "name", 8, 12),
], "name, category, s, e"))
def personal_data_examples(spark, sf_dir):
    from docloom.operators.pii import audit

    return audit(spark.createDataFrame(PRIVATE, "name string, text string"), "name", "text")


@query("SELECT * FROM " + values([("masked", 2)], "name, masked"))
def masked_examples(spark, sf_dir):
    from docloom.operators.pii import personal_data

    rows = spark.createDataFrame(PRIVATE, "name string, text string")
    return rows.select("name", personal_data(F.col("text"))["masked"].alias("masked")).where("masked > 0")


FACTS = [
    ("same date", "2026년 3월 12일 기준 1,250명", "2026-03-12 기준 1250명"), ("number", "3.5% 증가, 10개", "3.6% 증가, 10개"), ("unit", "5 kg", "5 km"),
    ("name", "GenX 와 Beta Corp", "GenX"), ("month", "3월 5일과 2026년 4월", "2026년 4월, 3월 5일"), ("empty", "", "7건"),
]


@query("SELECT name, numbers::BIGINT AS numbers, dates::BIGINT AS dates, units::BIGINT AS units, entities::BIGINT AS entities, passed FROM " + values([
    ("same date", 0, 0, 0, 0, True), ("number", 2, 0, 0, 0, False), ("unit", 0, 0, 2, 0, False), ("name", 0, 0, 0, 2, False), ("month", 0, 0, 0, 0, True), ("empty", 1, 0, 1, 0, False),
], "name, numbers, dates, units, entities, passed"))
def fact_examples(spark, sf_dir):
    from docloom.operators.facts import cross_check

    return cross_check(spark.createDataFrame(FACTS, "name string, a string, b string"), "name", "a", "b")


@query("SELECT name, kind, n_issues::BIGINT AS n_issues, first FROM " + values([("number", "numbers", 2, "+3.6, -3.5"), ("empty", "numbers", 1, "+7")], "name, kind, n_issues, first"))
def fact_issue_examples(spark, sf_dir):
    from docloom.operators.facts import issue_texts

    return issue_texts(spark.createDataFrame(FACTS, "name string, a string, b string"), "name", "a", "b")


DIRECTIONS = [
    ("declared Korean, English text", "ru", "ko", "An English text only"), ("Korean with Latin terms", "RU", "Korean", "ARR EBITDA CAPEX 수치를 매달 다시 계산했다"),
    ("target Korean", "ko-KR", "th", "한국어 문서"), ("same", "ko", "국문", "한국어"), ("no Korean", "en", "ru", "привет"), ("nothing known", "en", "", "123 456"),
    ("nothing known to Korean", "한국어", None, "123"), ("detected", "en", None, "한국어 문서이다"), ("unknown", "fr", "ko", "한국어"),
]


@query("SELECT * FROM " + values([
    ("declared Korean, English text", "ko", "ru", "en", True, "other_language", False), ("Korean with Latin terms", "ko", "ru", "en", True, "ok", False),
    ("target Korean", "th", "ko", "ko", True, "ok", False), ("same", "ko", "ko", "ko", False, "same_language", True), ("no Korean", "ru", "en", "ru", False, "no_korean", False),
    ("nothing known", None, "en", None, False, "source_needed", True), ("nothing known to Korean", None, "ko", None, False, "ok", True), ("detected", "ko", "en", "ko", False, "ok", True),
    ("unknown", "ko", None, "ko", False, "unknown_language", False),
], "name, source, target, detected, mismatch, verdict, glossary"))
def direction_examples(spark, sf_dir):
    from docloom.operators.directions import glossary_applies, resolve_direction

    rows = spark.createDataFrame(DIRECTIONS, "name string, target string, source string, text string")
    out = rows.select("name", resolve_direction(F.col("target"), F.col("source"), F.col("text"), _share).alias("d")).select("name", "d.*")
    return out.withColumn("glossary", glossary_applies(F.col("source"), F.col("target")))


MARKDOWN = [
    ("doc", "# Title one\n\nSome *text* here.  \n- item A\n  2) item b\n> quoted\n| h1 | 2 |\n|---|---|\n| x\\|y |  |\n```\ncode # no\n```\n<!-- PB -->\n## 42\ntail"),
    ("table", "Head, <table><tr><td>A &amp; B</td>\n<td>12</td></tr></table>after"), ("plain", "12.5 %\n"), ("open", "~~~\nx\n# y"), ("empty", ""), ("null", None),
]


@query("SELECT name, unit::BIGINT AS unit, type, text, context FROM " + values([
    ("doc", 0, "heading", "Title one", ""), ("doc", 1, "paragraph", "Some *text* here.", "Title one"), ("doc", 2, "list_item", "item A", "Title one"),
    ("doc", 3, "list_item", "item b", "Title one"), ("doc", 4, "blockquote", "quoted", "Title one"), ("doc", 5, "table_cell", "h1", "Title one"),
    ("doc", 6, "table_cell", "x\\|y", "Title one"), ("doc", 7, "paragraph", "tail", "42"),
    ("table", 0, "paragraph", "Head,", ""), ("table", 1, "html_table_text", "A & B", ""), ("table", 2, "paragraph", "after", ""),
], "name, unit, type, text, context"))
def markdown_unit_examples(spark, sf_dir):
    from docloom.operators.markdown import split_units

    return split_units(spark.createDataFrame(MARKDOWN, "name string, text string"), "name", "text").where("kind = 'unit'").select("name", "unit", "type", "text", "context")


@query("SELECT * FROM " + values([
    ("doc", MARKDOWN[0][1].replace("quoted", "q q").replace("| h1 |", "| a\\|b |")), ("table", MARKDOWN[1][1].replace("A &amp; B", "x &lt; &amp; y")), ("plain", "12.5 %\n"), ("open", "~~~\nx\n# y"), ("empty", ""), ("null", ""),
], "name, text"))
def markdown_rebuild_examples(spark, sf_dir):
    from docloom.operators.markdown import rebuild, split_units

    done = spark.createDataFrame([("doc", 4, "q\nq"), ("doc", 5, "a|b"), ("table", 1, "x < & y")], "name string, unit long, translated string")
    return rebuild(split_units(spark.createDataFrame(MARKDOWN, "name string, text string"), "name", "text"), done, "name")


@query("SELECT name, headings, table_rows, separator_rows::BIGINT AS separator_rows, fences::BIGINT AS fences, html_tables FROM " + values([
    ("doc", "1,2", "2,2", 1, 2, ""), ("table", "", "", 0, 0, "1x2"), ("plain", "", "", 0, 0, ""), ("open", "", "", 0, 1, ""), ("empty", "", "", 0, 0, ""), ("null", "", "", 0, 0, ""),
], "name, headings, table_rows, separator_rows, fences, html_tables"))
def markdown_structure_examples(spark, sf_dir):
    from docloom.operators.markdown import structure

    out = structure(spark.createDataFrame(MARKDOWN, "name string, text string"), "name", "text")
    return out.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("headings", "table_rows", "html_tables")})


EDITS = [
    ("same", "One two. Three four!", "One two. Three four!"), ("word", "The cat sat on the mat. It slept.", "The dog sat on the mat. It slept."),
    ("gone", "Keep this. Drop the second sentence here.", "Keep this."), ("new", "", "All new."), ("code", "a b\n```\nx = 1\n```\nc d e f g h", "a b\n```\nx = 2\n```\nc d e f g i"),
    ("tag", "see <b>x</b> now please do", "see <i>x</i> now please do"), ("structure", "# A\n| a | b |", "# A\n\n| a |"),
]


@query("SELECT name, n_changes::INT AS n_changes, source, target FROM " + values([
    ("same", 0, EDITS[0][1], EDITS[0][2]), ("word", 1, "The <mark>cat</mark> sat on the mat. It slept.", "The <mark>dog</mark> sat on the mat. It slept."),
    ("gone", 1, "Keep this. <mark>Drop the second sentence here.</mark>", "Keep this."), ("new", 1, "", "<mark>All new.</mark>"),
    ("code", 2, "a b\n```\nx = 1\n```\nc d e f g <mark>h</mark>", "a b\n```\nx = 2\n```\nc d e f g <mark>i</mark>"), ("tag", 2, EDITS[5][1], EDITS[5][2]),
    ("structure", 1, "# A\n| a | <mark>b |</mark>", "# A\n\n| a |"),
], "name, n_changes, source, target"))
def change_examples(spark, sf_dir):
    from docloom.operators.changes import highlighted

    return highlighted(spark.createDataFrame(EDITS, "name string, a string, b string"), "name", "a", "b")


@query("SELECT name, issues, passed FROM " + values([(n, "markdown_table" if n == "structure" else "", n != "structure") for n, *_ in EDITS if n != "code"] + [("code", "", True)], "name, issues, passed"))
def structure_issue_examples(spark, sf_dir):
    from docloom.operators.markdown import structure_issues

    rows = spark.createDataFrame([r for r in EDITS if r[0] != "new"] + [("new", "", "")], "name string, a string, b string")
    return structure_issues(rows, "name", "a", "b").select("name", F.array_join("issues", ",").alias("issues"), "passed")


@query("SELECT * FROM " + values([("a", "faq", "grounding_overlap", "items"), ("b", "translation", "glossary_compliance", "glossary"), ("b", "translation", "chrf_score", "pairs.reference"), ("b", "translation", "translation_structure_health", "records")], "run, feature, metric, missing"))
def skipped_metric_examples(spark, sf_dir):
    from docloom.operators.suites import metric_catalog, skipped

    given = spark.createDataFrame([("a", "faq", ["generation", "answers"]), ("b", "translation", ["pairs", "answers"])], "run string, feature string, inputs array<string>")
    return skipped(given, metric_catalog(spark))


@query("SELECT * FROM " + values(METRICS, "feature, metric, tag, needs, role"))
def metric_catalog(spark, sf_dir):
    from docloom.operators.suites import metric_catalog as catalog

    return catalog(spark)


@query(f"""WITH m AS {values(METRICS, 'feature, metric, tag, needs, role')}, t AS {values(TARGETS, 'feature, path, operator, value')}
  SELECT feature, count(*) AS n_metrics, count(*) FILTER (role = 'operational') AS n_operational, (SELECT count(*) FROM t WHERE t.feature = m.feature) AS n_targets FROM m GROUP BY feature""")
def suite_catalog(spark, sf_dir):
    from docloom.operators.suites import suites

    return suites(spark)


SLOTS = [
    (1, "{'제목'} 과 {“성명”, 굵게}"), (2, "{‘짝\"} {''} {'  '}"), (3, "{{'token'}} {'a'}"), (4, ""), (5, None), (6, "{ 'b' ,  크게, 12 }{'b'}"),
    (7, "{”no”} {'a' 16pt}{‘c'/ 굵게}"), (8, "{{'x'\n}} {{}}"),
]


@query("SELECT id, pos::INT AS pos, name, args FROM " + values([(1, 0, "제목", ""), (1, 1, "성명", "굵게"), (3, 0, "a", ""), (6, 0, "b", "크게, 12"), (6, 1, "b", ""), (7, 0, "a", "16pt"), (7, 1, "c", "굵게"), (8, 0, "x", "")], "id, pos, name, args"))
def slot_examples(spark, sf_dir):
    rows = spark.createDataFrame(SLOTS, "id int, text string").select("id", F.posexplode(templates.slots(F.col("text"))).alias("pos", "s"))
    return rows.select("id", "pos", "s.name", "s.args")


ECHOES = [(1, "제목", "제목: 실적"), (2, "제목", " 제목： 보고 "), (3, "제목", "제목 실적"), (4, "a", ""), (5, "a", None)]


@query("SELECT * FROM " + values([(1, "실적"), (2, "보고"), (3, "제목 실적"), (4, ""), (5, None)], "id, value"))
def echoed_name_examples(spark, sf_dir):
    rows = spark.createDataFrame(ECHOES, "id int, name string, value string")
    return rows.select("id", templates.strip_echoed_name(F.col("name"), F.col("value")).alias("value"))


PLACES = [
    ("d", 0, "a", "", "SLOT", "", False), ("d", 1, "b", None, "SLOT", " x ", True), ("d", 2, "a", "how", "CLICK_HERE", "y", True),
    ("d", 3, "b", "g", "SLOT", "z", True), ("e", 0, "a", "", "SLOT", None, None),
]


@query("SELECT doc, name, pos::INT AS pos, guide, field_type, occurrences::BIGINT AS occurrences, filled, current_value, source FROM " + values([
    ("d", "a", 0, "how", "CLICK_HERE", 2, False, "y", "field"), ("d", "b", 1, "g", "SLOT", 2, True, "x", "slot"), ("e", "a", 0, "", "SLOT", 1, False, "", "slot"),
], "doc, name, pos, guide, field_type, occurrences, filled, current_value, source"))
def field_examples(spark, sf_dir):
    names = "doc string, pos int, name string, guide string, field_type string, value string, filled boolean"
    return templates.merge_fields(spark.createDataFrame(PLACES, names), "doc")


COPIES = [
    ("d", "주제1", "x"), ("d", "주제3", "y"), ("d", "내용1-2", "z"), ("d", "내용2-4", " "), ("d", "주제9", "over"), ("d", "내용1-7", "over"),
    ("e", "기타", "x"), ("f", "내용2-3", "x"), ("f", "주제2", None),
]


@query("SELECT doc, k, n_inner FROM " + values([("d", 1, 2), ("d", 2, 1), ("d", 3, 1), ("e", 1, 1), ("f", 1, 1), ("f", 2, 3)], "doc, k, n_inner"))
def group_count_examples(spark, sf_dir):
    rows = spark.createDataFrame(COPIES, "doc string, name string, value string")
    return templates.group_counts(rows, "doc", r"^주제(\d+)$", r"^내용(\d+)-(\d+)$", 5, 5)


NUMBERS = [
    (1, "HANGUL_SYLLABLE", "가"), (15, "HANGUL_SYLLABLE", "가가"), (0, "HANGUL_JAMO", ""), (3, "HANGUL_JAMO", "ㄷ"), (20, "CIRCLED_DIGIT", "⑳"), (21, "CIRCLED_DIGIT", "21"),
    (2, "CIRCLED_HANGUL_SYLLABLE", "㉯"), (15, "CIRCLED_HANGUL_JAMO", "ㄱㄱ"), (28, "LATIN_CAPITAL", "BB"), (53, "LATIN_SMALL", "aaa"), (26, "LATIN_SMALL", "z"),
    (1994, "ROMAN_CAPITAL", "MCMXCIV"), (48, "ROMAN_SMALL", "xlviii"), (0, "ROMAN_SMALL", ""), (7, "OTHER", "7"), (7, None, "7"), (None, "LATIN_SMALL", None), (None, "ROMAN_SMALL", None),
]


@query("SELECT * FROM " + values(NUMBERS, "number, form, text"))
def number_form_examples(spark, sf_dir):
    rows = spark.createDataFrame([x[:2] for x in NUMBERS], "number int, form string")
    return rows.withColumn("text", templates.format_number(F.col("number"), F.col("form")))


ASKED = [(1, "5"), (2, "99"), (3, "-1"), (4, "x"), (5, None), (6, "30")]


@query("SELECT * FROM " + values([(1, 5, False), (2, 30, True), (3, 0, False), (4, 10, False), (5, 10, False), (6, 30, False)], "id, count, clamped"))
def count_examples(spark, sf_dir):
    rows = spark.createDataFrame(ASKED, "id int, requested string")
    return rows.select("id", templates.resolve_count(F.col("requested"), 30, 10).alias("c")).select("id", "c.*")
