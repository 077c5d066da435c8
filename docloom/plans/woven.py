"""Queries over the driver's tables with text woven in by key, where the tables hold no such text: identifiers, slots, Markdown, names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import facts, markdown, pii, suites, templates
from .audits import _facts_sql
from .registry import query, table
from .turns import TURN_PAIRS, turn_pairs

#: What is woven in: every so-many-th document, the category of the find (none: it must not be one), text before it, the identifier, text after it.
WOVEN = [
    (2, "card", " 카드 ", "4111 1111 1111 1111", "."), (3, "rrn", " 번호 ", "900101-1234568", " 입니다"), (4, "phone", " 전화 ", "010-1234-5678", ","), (5, "name", " ", "김민준", " 대리"),
    (6, "biz", " 사업자 ", "123-45-67891", " "), (7, "email", " ", "a.b@c-d.co.kr", " 로"), (8, "driver_license", " 면허 ", "11-22-333333-44", " "), (9, "passport", " 여권 ", "M12345678", " "),
    (10, None, " 틀린 ", "4111 1111 1111 1112", " "), (11, None, " 틀린 ", "900101-1234567", " "), (12, None, " 사람 ", "김민준이", " 왔다"),
]


def _woven(docs: DataFrame) -> DataFrame:
    """``docs`` with identifiers behind each text, by the number of the document."""
    parts = [F.when(F.col("doc_id") % k == 0, before + said + after).otherwise("") for k, _, before, said, after in WOVEN]
    return docs.select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("n"), F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), *parts).alias("text"))


def _woven_sql() -> str:
    """(doc_id, category, start, end) of what is woven in."""
    rows, so_far = [], "length(coalesce(text, '')) + 1"
    for k, category, before, said, after in WOVEN:
        if category:
            rows.append(f"SELECT doc_id, '{category}' AS category, ({so_far} + {len(before)})::INT AS start, ({so_far} + {len(before + said)})::INT AS \"end\" FROM documents WHERE doc_id % {k} = 0")
        so_far += f" + CASE WHEN doc_id % {k} = 0 THEN {len(before + said + after)} ELSE 0 END"
    return " UNION ALL ".join(rows)


@query(_woven_sql())
def woven_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every document holds what was woven in behind its text."""
    docs = _woven(table(spark, sf_dir, "documents"))
    found = docs.select("doc_id", "n", F.inline(pii.personal_data(F.col("text"))["found"]))
    return found.where("start > n").select("doc_id", "category", "start", "end")


@query(f"SELECT category, count(*) AS n_found FROM ({_woven_sql()}) GROUP BY category")
def woven_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many more finds of each kind the woven texts have than the texts as they are."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    more = pii.leaks(_woven(docs), "text").select("category", "n_found").unionByName(pii.leaks(docs, "text").select("category", (-F.col("n_found")).alias("n_found")))
    return more.where("category NOT IN ('all', 'masked')").groupBy("category").agg(F.sum("n_found").alias("n_found"))


@query("""WITH o AS (SELECT o_orderkey, o_orderkey % 4 AS k, floor(o_totalprice)::BIGINT AS n, o_orderdate::DATE AS d FROM orders)
SELECT o_orderkey, 'numbers' AS kind, CASE k WHEN 1 THEN 2 ELSE 1 END::BIGINT AS n_issues, CASE k WHEN 1 THEN '+' || (n + 1) || ', -' || n ELSE '-' || n END AS first FROM o WHERE k IN (1, 3)
UNION ALL SELECT o_orderkey, 'dates', 2, '+' || strftime(d + 1, '%Y-%m-%d') || ', -' || strftime(d, '%Y-%m-%d') FROM o WHERE k = 2""")
def order_fact_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers and dates of every order's note that a second note of it lacks or changes."""
    n, day = F.floor("o_totalprice").cast("bigint"), F.col("o_orderdate").cast("date")
    note = lambda n, day: F.concat(F.lit("Total "), n, F.lit(" on "), F.date_format(day, "yyyy-MM-dd"), F.lit("."))
    commas = F.regexp_replace(n.cast("string"), "(?<=\\d)(?=(\\d{3})+$)", ",")
    other = [note(commas, day), note((n + 1).cast("string"), day), note(n.cast("string"), F.date_add(day, 1)), note(F.lit("unknown"), day)]
    rows = table(spark, sf_dir, "orders").select("o_orderkey", note(n.cast("string"), day).alias("a"), F.element_at(F.array(*other), (F.col("o_orderkey") % 4 + 1).cast("int")).alias("b"))
    return facts.issue_texts(rows, "o_orderkey", "a", "b")


@query("""SELECT c_custkey, p.pos::INT AS pos, p.name, p.args FROM customer, LATERAL (SELECT unnest([0, 1, 2]) AS pos, unnest([c_name, c_mktsegment, 'no ' || c_custkey]) AS name, unnest(['', 'bold, 12', '16pt']) AS args) p
WHERE p.pos < 2 OR c_custkey % 3 = 0""")
def customer_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slots of a letter to every customer."""
    c = table(spark, sf_dir, "customer")
    third = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit(" {“no "), F.col("c_custkey").cast("string"), F.lit("” 16pt}"))).otherwise(" {'unpaired” x}")
    text = F.concat(F.lit("Dear {'"), F.col("c_name"), F.lit("'} of {\" "), F.col("c_mktsegment"), F.lit(" \", bold, 12}, {{'token'}}"), third, F.lit(" {''}"))
    rows = c.select("c_custkey", F.posexplode(templates.slots(text)).alias("pos", "s"))
    return rows.select("c_custkey", "pos", "s.name", "s.args")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment WHEN c_custkey % 4 = 1 THEN c_mktsegment || ' ' || c_name WHEN c_custkey % 4 = 2 THEN c_name || ' ' || c_mktsegment ELSE '' END AS value FROM customer""")
def customer_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of a field named after the customer, without the name where it stands before a colon."""
    said = [F.concat("c_name", F.lit(": "), "c_mktsegment"), F.concat(F.lit(" "), "c_name", F.lit("： "), "c_mktsegment", F.lit(" "), "c_name"), F.concat("c_name", F.lit(" "), "c_mktsegment"), F.concat("c_name", F.lit(":"))]
    value = F.element_at(F.array(*said), (F.col("c_custkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", templates.strip_echoed_name(F.col("c_name"), value).alias("value"))


@query("""WITH p AS (SELECT l_orderkey, l_linenumber AS pos, 'f' || l_partkey % 3 AS name, CASE WHEN l_suppkey % 2 = 0 THEN l_shipdate::DATE::VARCHAR ELSE '' END AS guide, l_suppkey % 5 = 0 AS field, trim(l_returnflag) AS value, l_linestatus = 'F' AS filled FROM lineitem)
SELECT l_orderkey, name, min(pos)::INT AS pos, coalesce(min({'p': pos, 'x': guide}) FILTER (guide <> '')['x'], '') AS guide, CASE WHEN bool_or(field) THEN 'CLICK_HERE' ELSE 'SLOT' END AS field_type, count(*) AS occurrences,
  bool_and(filled) AS filled, coalesce(min({'p': pos, 'x': value}) FILTER (filled)['x'], '') AS current_value, CASE WHEN bool_or(field) THEN 'field' ELSE 'slot' END AS source FROM p GROUP BY l_orderkey, name""")
def order_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that the lines of every order make up."""
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").cast("int").alias("pos"), F.concat(F.lit("f"), (F.col("l_partkey") % 3).cast("string")).alias("name"),
        F.when(F.col("l_suppkey") % 2 == 0, F.col("l_shipdate").cast("date").cast("string")).alias("guide"), F.when(F.col("l_suppkey") % 5 == 0, "CLICK_HERE").otherwise("SLOT").alias("field_type"),
        F.concat(F.lit(" "), "l_returnflag").alias("value"), (F.col("l_linestatus") == "F").alias("filled"),
    )
    return templates.merge_fields(rows, "l_orderkey")


@query("""WITH v AS (SELECT l_orderkey, l_linenumber AS k, (l_quantity % 6)::INT AS j FROM lineitem), g AS (SELECT l_orderkey, k, max(CASE WHEN j BETWEEN 1 AND 4 THEN j WHEN j = 0 THEN 1 END) AS j FROM v WHERE k <= 5 AND j <> 5 GROUP BY ALL),
c AS (SELECT o.l_orderkey, coalesce(max(k), 1) AS copies FROM (SELECT DISTINCT l_orderkey FROM lineitem) o LEFT JOIN g USING (l_orderkey) GROUP BY ALL)
SELECT e.l_orderkey, e.k::INT AS k, coalesce(j, 1)::INT AS n_inner FROM (SELECT l_orderkey, unnest(generate_series(1, copies)) AS k FROM c) e LEFT JOIN g ON g.l_orderkey = e.l_orderkey AND g.k = e.k""")
def order_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of a repeated group, and of the items in it, that the lines of every order ask for."""
    j = (F.col("l_quantity") % 6).cast("int")
    k = F.col("l_linenumber").cast("string")
    name = F.when(j == 0, F.concat(F.lit("topic"), k)).otherwise(F.concat(F.lit("item"), k, F.lit("-"), j.cast("string")))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", name.alias("name"), F.lit("x").alias("value"))
    return templates.group_counts(rows, "l_orderkey", r"^topic(\d+)$", r"^item(\d+)-(\d+)$", 5, 4)


@query("""WITH p AS (SELECT p_partkey, p_size AS n, p_partkey % 5 AS f FROM part),
r AS (SELECT *, ['', 'x', 'xx', 'xxx', 'xl', 'l'][n // 10 + 1] || ['', 'i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix'][n % 10 + 1] AS roman FROM p)
SELECT p_partkey, CASE f WHEN 0 THEN roman WHEN 1 THEN upper(roman) WHEN 2 THEN repeat(chr(97 + (n - 1) % 26), (n - 1) // 26 + 1) WHEN 3 THEN CASE WHEN n <= 20 THEN chr(9311 + n) ELSE n::VARCHAR END
  ELSE repeat(substr('가나다라마바사아자차카타파하', (n - 1) % 14 + 1, 1), (n - 1) // 14 + 1) END AS text FROM r""")
def part_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size of every part as a list number, in one of five forms."""
    form = F.element_at(F.array(*map(F.lit, ("ROMAN_SMALL", "ROMAN_CAPITAL", "LATIN_SMALL", "CIRCLED_DIGIT", "HANGUL_SYLLABLE"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", templates.format_number(F.col("p_size"), form).alias("text"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN least(p_size, 30) WHEN 1 THEN 0 WHEN 2 THEN 10 ELSE least(p_size * 3, 30) END::INT AS count,
  CASE p_partkey % 4 WHEN 0 THEN p_size > 30 WHEN 3 THEN p_size * 3 > 30 ELSE false END AS clamped FROM part""")
def part_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of items asked for, as they are granted."""
    size = F.col("p_size")
    asked = F.element_at(F.array(size.cast("string"), (-size).cast("string"), F.concat(size.cast("string"), F.lit(" pieces")), F.concat(F.lit(" "), (size * 3).cast("string"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", templates.resolve_count(asked, 30, 10).alias("c")).select("p_partkey", "c.*")


#: Markdown that goes before a document's text; letters a, e, o and u tell what is translated.
HEAD = "# Title aeou\n- item **one** | two\n> quoted aeou\n| head aeou | 12 |\n|---|---|\n| aeou | x\\|o |\n```\ncode aeou\n```\n"
OWN = "[<&`~|#]"
HTML = "<table><tr><td>aeou &amp; o</td></tr></table>\n"
DONE_HEAD, DONE_HTML = (x.translate(str.maketrans("aeou", "4301")) for x in ("# Title aeou\n- item **one** | two\n> quoted aeou\n| head aeou | 12 |\n|---|---|\n| aeou | x\\|o |\n```\n", "aeou &amp; o"))


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with Markdown before them; their own signs of Markdown and HTML are taken out, so that SQL can follow."""
    own = F.regexp_replace(F.coalesce("text", F.lit("")), OWN, "")
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit(HEAD + HTML), own).alias("text"))


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


_TRANSLATED = f"{_sql_text(DONE_HEAD)} || 'code aeou' || chr(10) || '```' || chr(10) || '<table><tr><td>' || '4301 &amp; 0' || '</td></tr></table>' || chr(10) || translate(regexp_replace(coalesce(text, ''), '{OWN}', '', 'g'), 'aeou', '4301')"


@query(f"SELECT doc_id, md5({_TRANSLATED}) AS form FROM documents")
def markdown_translated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, with Markdown before it, put together again from its units with some letters changed; code and marks stay."""
    docs = _marked(spark, sf_dir).repartition("doc_id")  # dealt before they are cut, so that units and translations stay where they are
    cut = markdown.split_units(docs, "doc_id", "text")
    said = cut.where("kind = 'unit'").select("doc_id", "unit", F.translate("text", "aeou", "4301").alias("translated"))
    return markdown.rebuild(cut, said, "doc_id").select("doc_id", F.md5("text").alias("form"))


@query("""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'heading' WHEN 2 THEN 'markdown_table' WHEN 3 THEN 'html_table' ELSE 'code_fence' END AS issues, doc_id % 5 = 0 AS passed FROM documents""")
def edited_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What differs in the structure of every document after one of five edits to the Markdown before it."""
    rows = _marked(spark, sf_dir)
    edits = [("one", "ONE"), ("# Title", "## Title"), ("| head aeou | 12 |", "| head aeou |"), ("<td>", "<td></td><td>"), ("\n```\n<table>", "\n<table>")]
    after = F.element_at(F.array(*[F.replace("text", F.lit(a), F.lit(b)) for a, b in edits]), (F.col("doc_id") % 5 + 1).cast("int"))
    return markdown.structure_issues(rows.withColumn("after", after), "doc_id", "text", "after").select("doc_id", F.array_join("issues", ",").alias("issues"), "passed")


@query(f"""WITH {TURN_PAIRS}, sides AS (SELECT pair, 1 AS side, a AS t FROM pairs UNION ALL SELECT pair, -1, b FROM pairs), {_facts_sql('pair')},
  r AS (SELECT pair, split_part(pair, '/', 1)::BIGINT % 10 AS run, length(b) > 0 AS answered FROM pairs),
  f AS (SELECT run, avg((n IS NULL)::INT) AS facts, avg(answered::INT) AS answered FROM r LEFT JOIN (SELECT pair, count(*) AS n FROM diff GROUP BY pair) USING (pair) GROUP BY run)
  SELECT run, CASE WHEN facts = 1 THEN 'pass_but_incomplete' ELSE 'fail' END AS verdict, (facts = 1)::BIGINT AS n_passed, (facts < 1)::BIGINT AS n_failed, 4::BIGINT AS n_not_measured FROM f""")
def turn_suites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The translation suite over every tenth of the conversations, its facts checked by their operator; what isn't measured says so."""
    checked = facts.cross_check(turn_pairs(spark, sf_dir), "pair", "a", "b")
    run = F.split("pair", "/")[0].cast("long") % 10
    rates = checked.groupBy(run.alias("run")).agg(F.avg(F.col("passed").cast("double")).alias("actual"))
    measured = rates.select("run", F.lit("translation").alias("feature"), F.lit("fact_preservation_check.pass_rate").alias("path"), "actual")
    return suites.verdicts(suites.check_targets(measured, suites.targets(spark))).drop("feature")
