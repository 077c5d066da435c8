"""Queries of the document operators: languages, dictionaries, chunks, pages, guards, sessions and records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .queries import PAIRS, W, _pairs
from .registry import BASES, query, table

VI = "[ăâđêôơưĂÂĐÊÔƠƯáàảãạắằẳẵặấầẩẫậéèẻẽẹếềểễệíìỉĩịóòỏõọốồổỗộớờởỡợúùủũụứừửữựýỳỷỹỵ]"
SENTENCES = "list_filter(list_transform(string_split(regexp_replace(regexp_replace({0}, '([.!?])[ \\t\\r\\f\\x0B]+', '\\1' || chr(10), 'g'), '([다요]\\.)', '\\1' || chr(10), 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '')"


def _lines(spark, sf_dir) -> DataFrame:
    """Lines of documents as blocks: those with bars are tables; every tenth line begins a section."""
    t = table(spark, sf_dir, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return t.withColumns({"section": F.floor(F.col("pos") / 10).cast("int"), "kind": F.when(F.contains("text", F.lit("|")), "table").otherwise("paragraph")})


BASES["detect_language"] = f"""WITH n AS (SELECT doc_id, len(regexp_extract_all(substr(text, 1, 4000), '{VI}')) AS v, len(regexp_extract_all(substr(text, 1, 4000), '\\p{{Latin}}')) AS l,
    len(regexp_extract_all(substr(text, 1, 4000), '[가-힣ᄀ-ᇿ㄰-㆏]')) AS k, len(regexp_extract_all(substr(text, 1, 4000), '[Ѐ-ԯ]')) AS r, len(regexp_extract_all(substr(text, 1, 4000), '[一-鿿㐀-䶿豈-﫿]')) AS z,
    len(regexp_extract_all(substr(text, 1, 4000), '[฀-๿]')) AS t FROM documents), m AS (SELECT *, l + k + r + z + t AS total, greatest(l, k, r, z, t) AS top FROM n)
  SELECT doc_id, CASE WHEN coalesce(total, 0) = 0 THEN '' WHEN l = top THEN CASE WHEN v > 0 THEN 'vi' ELSE 'en' END WHEN k = top THEN 'ko' WHEN r = top THEN 'ru' WHEN z = top THEN 'zh' ELSE 'th' END AS code,
  CASE WHEN coalesce(total, 0) = 0 THEN 0.0 ELSE round(top / total, 4) END::DOUBLE AS share FROM m"""


@query(BASES["detect_language"].replace("substr(text, 1, 4000)", "text"))
def detect_language_whole(spark, sf_dir):
    from ..functions.language import detect

    return table(spark, sf_dir, "documents").select("doc_id", detect(F.col("text")).alias("d")).select("doc_id", "d.*")


BASES["verb_stems"] = """WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM benchmark UNION SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) FROM documents WHERE lang = 'en'),
  s AS (SELECT word, regexp_extract(word, '^([a-z]{2,})ied$', 1) AS i, regexp_extract(word, '^([a-z]{3,})(?:ed|ing)$', 1) AS s FROM w)
  SELECT word, CASE WHEN i <> '' THEN i || 'y' WHEN s = '' THEN '' WHEN s[-1] = s[-2] AND s[-1] NOT IN ('a', 'e', 'i', 'o', 'u') THEN s || ' ' || s || 'e ' || s[:-2] ELSE s || ' ' || s || 'e' END AS stems FROM s"""


def _terms(spark, sf_dir) -> DataFrame:
    """A dictionary: the first one, two and three words of benchmark items."""
    w = table(spark, sf_dir, "benchmark").select(F.split("text", " ").alias("w"))
    return w.select(F.explode(F.array(*[F.array_join(F.slice("w", 1, n), " ") for n in (1, 2, 3)])).alias("term")).distinct()


@query()
def dictionary_matches(spark, sf_dir):
    from ..operators.glossary import match_terms

    return match_terms(table(spark, sf_dir, "documents"), "doc_id", "text", _terms(spark, sf_dir))


@query()
def dictionary_usage(spark, sf_dir):
    from ..operators.glossary import match_terms, usage
    from ..operators.ordered import cut_lineage
    from .turns import turn_pairs

    p = cut_lineage(turn_pairs(spark, sf_dir))
    terms = p.select(F.explode(F.split("a", " ")).alias("term")).distinct()
    return usage(match_terms(p, "pair", "a", terms, once=True), "pair", terms.select("term", F.col("term").alias("answer")), p, "b")


@query("""WITH p AS (SELECT n_name AS a, r_name AS b FROM nation JOIN region ON n_regionkey = r_regionkey), r AS (SELECT a AS term, b AS answer FROM p UNION ALL SELECT b, a FROM p),
  m AS (SELECT lower(term) AS k, min({'t': term, 'a': answer}) AS r FROM r GROUP BY ALL) SELECT r.t AS term, r.a AS answer FROM m""")
def dictionary_index(spark, sf_dir):
    from ..operators.glossary import both_ways

    p = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return both_ways(p.select(F.array("n_name").alias("a"), F.array("r_name").alias("b")), "a", "b")


@query()
def line_chunks(spark, sf_dir):
    from ..operators.chunking import split_lines

    out = split_lines(table(spark, sf_dir, "documents"), "doc_id", "text", 2000)
    return out.select("doc_id", "i", F.length("piece").alias("n_char"), F.md5("piece").alias("form"))


@query("SELECT doc_id, md5(text) AS form FROM documents WHERE text <> ''")
def rebuild_chunks(spark, sf_dir):
    from ..operators.chunking import rebuild, split_lossless

    cut = split_lossless(table(spark, sf_dir, "documents"), "doc_id", "text", 1000)
    none = cut.select("doc_id", "i", F.lit(None).cast("string").alias("result")).where("false")
    return rebuild(cut, none, "doc_id").select("doc_id", F.md5("text").alias("form"))


@query()
def block_chunks(spark, sf_dir):
    from ..operators.chunking import chunk_blocks

    out = chunk_blocks(_lines(spark, sf_dir), "doc_id", "pos")
    return out.select("doc_id", "i", "section", "kind", F.length("text").alias("n_char"), F.md5("text").alias("form"))


@query()
def unit_batches(spark, sf_dir):
    from ..operators.chunking import pack_batches

    return pack_batches(_lines(spark, sf_dir), "doc_id", "pos", "text", 4000, 10)


#: Headings that are woven in before a document's lines, with their levels; the last stands in every fourth document, alone of its kind, so it is none.
HEADS = (("1. 개요", 2), ("가. 배경", 3), ("이 문장은 제목이 아니다.", 0), ("나. 목적", 3), ("2. 결론", 2), ("1) 하나", 0))


@query("SELECT doc_id, pos, level, label FROM documents, (VALUES " + ", ".join(f"({i - len(HEADS)}, {level}, '{text}')" for i, (text, level) in enumerate(HEADS) if level) + ") h(pos, level, label)")
def office_outline(spark, sf_dir):
    """Headings of every document's report: those woven in before its lines."""
    from ..operators.outline import office_outline as outline

    lines = _lines(spark, sf_dir).select("doc_id", "pos", "text")
    heads = F.array(*[F.struct(F.lit(i - len(HEADS)).alias("pos"), F.lit(text).alias("text")) for i, (text, _) in enumerate(HEADS)])
    some = F.filter(heads, lambda h: (h["pos"] < -1) | (F.col("doc_id") % 4 == 0))
    woven = table(spark, sf_dir, "documents").select("doc_id", F.inline(some))
    return outline(lines.unionByName(woven), "doc_id", "pos").where("level > 0 AND pos < 0").select("doc_id", "pos", "level", "label")


@query("""SELECT doc_id, pos, CASE WHEN kind = 'table' AND pk = 'paragraph' AND length(pt) BETWEEN 1 AND 60 THEN pt END AS table_title FROM (SELECT *, lag(kind) OVER w AS pk, lag(text) OVER w AS pt FROM (
    SELECT doc_id, unnest(range(0, len(l)))::INT AS pos, unnest(l) AS text, CASE WHEN unnest(l) LIKE '%|%' THEN 'table' ELSE 'paragraph' END AS kind FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))
  WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) WHERE kind = 'table'""")
def table_titles(spark, sf_dir):
    from ..operators.outline import title_tables

    return title_tables(_lines(spark, sf_dir), "doc_id", "pos").where("kind = 'table'").select("doc_id", "pos", "table_title")


@query()
def addenda_pairs(spark, sf_dir):
    from ..operators.revisions import pair_addenda

    t = table(spark, sf_dir, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    a = t.where("event_type = 'click'").select("user_id", F.col("event_id").alias("i"), F.lit(None).cast("long").alias("date"), us.alias("effective"))
    return pair_addenda(a, t.where("event_type = 'purchase'").select("user_id", us.alias("date")), "user_id")


@query("""WITH d AS (SELECT doc_id // 40 AS report, doc_id, list_concat(list_concat(['Quarterly report ' || doc_id // 40 || ' on ' || coalesce(source, '') || ' - ' || ['draft', 'second draft', 'revised', 'final'][doc_id % 4 + 1]],
    string_split(coalesce(text, ''), chr(10))), ['Office of papers, room ' || doc_id || CASE WHEN doc_id % 3 = 0 THEN ' (annex)' ELSE '' END, doc_id::VARCHAR]) AS l FROM documents),
  x AS (SELECT report, doc_id, regexp_replace(unnest(l), '[0-9 \\t\\n\\r\\f\\x0B]+', '', 'g') AS k FROM d),
  n AS (SELECT report, greatest(3, ceil(count(DISTINCT doc_id) * 0.25)) AS need FROM d GROUP BY report)
  SELECT report, k AS running, count(DISTINCT doc_id) AS pages FROM x JOIN n USING (report) WHERE length(k) >= 2 GROUP BY report, k, need HAVING count(DISTINCT doc_id) >= need""")
def running_lines(spark, sf_dir):
    """Lines that stand, but for digits and blanks, on a quarter of a report's pages."""
    from ..operators.layout import running_keys
    from .headers import _lines as report_lines

    return running_keys(report_lines(spark, sf_dir), "report", "page", "text")


@query("SELECT conv_id, turn::INT AS page, md5(trim(text)) AS form FROM conversations WHERE trim(text) <> ''")
def split_pages(spark, sf_dir):
    from ..operators.layout import split_pages as split

    t = table(spark, sf_dir, "conversations")
    part = F.concat(F.lit("[[PAGE "), F.col("turn").cast("string"), F.lit("]]"), F.coalesce("text", F.lit("")))
    whole = t.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", part.alias("x")))), lambda r: r["x"]), "").alias("text"))
    return split(whole, "conv_id", "text").select("conv_id", "page", F.md5("text").alias("form"))


@query("""SELECT l.event_id, p.page::BIGINT AS page FROM (SELECT event_id, user_id, epoch_us(ts) AS at FROM events WHERE event_type = 'click') l
  ASOF LEFT JOIN (SELECT user_id, epoch_us(ts) AS start, max(event_id) AS page FROM events WHERE event_type = 'purchase' GROUP BY ALL) p ON l.user_id = p.user_id AND l.at >= p.start""")
def pages_of_places(spark, sf_dir):
    from ..operators.layout import pages_of

    t = table(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    starts = t.where("event_type = 'purchase'").select("user_id", F.col("at").alias("start"), F.col("event_id").alias("page"))
    return pages_of(t.where("event_type = 'click'").select("event_id", "user_id", "at"), starts, "user_id", "at").select("event_id", "page")


@query("""WITH b AS (SELECT l_suppkey AS doc, l_orderkey AS page, l_linenumber * 20.0 AS y0, l_linenumber * 20.0 + l_quantity / 2 AS y1, round(l_discount * 100, 0) AS x0, l_quantity * 10 AS x1 FROM lineitem),
  m AS (SELECT doc, x0, count(*) AS n FROM b GROUP BY ALL), a AS (SELECT doc, arg_max(x0, (n, -x0)) AS x0 FROM m GROUP BY doc),
  g AS (SELECT doc, x1, y0 - lag(y1) OVER (PARTITION BY doc, page ORDER BY y0, x0) AS g FROM b), c AS (SELECT doc, max(x1) AS x1, list_sort(list(g) FILTER (g > 0)) AS s FROM g GROUP BY doc)
  SELECT doc, x0::DOUBLE AS x0, x1::DOUBLE AS x1, s[len(s) // 2 + 1]::DOUBLE AS gap FROM a JOIN c USING (doc)""")
def page_geometry(spark, sf_dir):
    from ..operators.layout import geometry

    y = F.col("l_linenumber") * 20.0
    b = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("doc"), F.col("l_orderkey").alias("page"), y.alias("y0"), (y + F.col("l_quantity") / 2).alias("y1"), F.round(F.col("l_discount") * 100).alias("x0"), (F.col("l_quantity") * 10).alias("x1")
    )
    return geometry(b, "doc")


@query()
def page_paragraphs(spark, sf_dir):
    """Line items as boxes of an order's page: rows, joined boxes, reading order, paragraphs."""
    from ..operators.layout import box_rows, merge_rows, paragraphs, reading_order
    from ..operators.ordered import dealt, parts_for

    y, x = F.col("l_linenumber") * 12.0, F.col("l_discount") * 1000
    boxes = table(spark, sf_dir, "lineitem").select("l_orderkey", x.alias("x0"), y.alias("y0"), (x + F.col("l_quantity") * 10).alias("x1"), (y + 10.0).alias("y1"), F.col("l_shipdate").cast("string").alias("text"))
    parts = parts_for(table(spark, sf_dir, "lineitem"))
    # dealt once: what follows keeps together what a page keeps together
    lines = merge_rows(dealt(box_rows(boxes, ["l_orderkey"], parts), ["l_orderkey"], parts), ["l_orderkey"]).withColumn("gutter", F.lit(None).cast("double"))
    return paragraphs(reading_order(lines, ["l_orderkey"], "gutter"), ["l_orderkey"])


_FORM = "lower(trim(regexp_replace(regexp_replace(regexp_replace({0}, '<[^>]*>', ' ', 'g'), '[*_`#>|~]+', ' ', 'g'), '" + W + "', ' ', 'g')))"
_GRAMS = "list_distinct(list_transform(range(1, greatest(length({0}) - 2, 1) + 1), lambda i: substr({0}, i, 3)))"


BASES["evidence_ratio"] = f"""WITH {PAIRS}, f AS (SELECT conv_id, {_FORM.format('b')} AS e, {_FORM.format('a')} AS d FROM pairs)
  SELECT conv_id, CASE WHEN e = '' THEN 0.0 WHEN contains(d, e) THEN 1.0 WHEN d = '' THEN 0.0 ELSE round(len(list_intersect({_GRAMS.format('e')}, {_GRAMS.format('d')})) / len({_GRAMS.format('e')}), 4) END::DOUBLE AS ratio FROM f"""


def _word_grams(x: str) -> str:
    w = f"list_filter(string_split_regex(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}_ \\t\\n\\r\\f\\x0B]', ' ', 'g'), '{W}'), lambda y: y <> '')"
    return f"list_distinct(list_transform(range(1, CASE WHEN len({w}) = 0 THEN 1 ELSE greatest(len({w}) - 2, 1) + 1 END), lambda i: array_to_string({w}[i:i + 2], ' ')))"


BASES["grounding"] = f"""WITH {PAIRS}, a0 AS (SELECT conv_id, {SENTENCES.format('a')} AS l, {SENTENCES.format('b')} AS m FROM pairs),
  a AS (SELECT conv_id, unnest(range(0, len(m))) AS i, unnest(m) AS x FROM a0), b AS (SELECT conv_id, unnest(range(0, len(l))) AS j, unnest(l) AS x FROM a0),
  ga AS (SELECT conv_id, i, g AS s, len(g) AS n FROM (SELECT conv_id, i, {_word_grams('x')} AS g FROM a) WHERE len(g) > 0), gb AS (SELECT conv_id, j, g AS s, len(g) AS n FROM (SELECT conv_id, j, {_word_grams('x')} AS g FROM b) WHERE len(g) > 0),
  u AS (SELECT conv_id, list_distinct(flatten(list(s))) AS s FROM gb GROUP BY conv_id),
  o AS (SELECT conv_id, i, round(len(list_intersect(ga.s, coalesce(u.s, []))) / n, 4) AS o FROM ga LEFT JOIN u USING (conv_id)),
  j AS (SELECT conv_id, i, round(coalesce(max(len(list_intersect(ga.s, gb.s)) / (ga.n + gb.n - len(list_intersect(ga.s, gb.s)))), 0), 4) AS b FROM ga LEFT JOIN gb USING (conv_id) GROUP BY conv_id, i)
  SELECT conv_id, count(*) AS n, round(avg(o), 4) AS mean_overlap, min(o) AS min_overlap, round(avg(b), 4) AS best_mean FROM o JOIN j USING (conv_id, i) GROUP BY conv_id"""


BASES["value_verdicts"] = f"""WITH {PAIRS}, t AS (SELECT conv_id, {_FORM.format('a')} AS x, {_FORM.format('b')} AS y FROM pairs), n AS (SELECT conv_id, trim(regexp_replace(regexp_replace(lower(a), '[^\\p{{L}}\\p{{N}}\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS a,
  trim(regexp_replace(regexp_replace(lower(b), '[^\\p{{L}}\\p{{N}}\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS b FROM pairs)
  SELECT conv_id, CASE WHEN a = b THEN 'exact' WHEN a <> '' AND b <> '' AND (contains(a, b) OR contains(b, a)) THEN 'partial' ELSE 'wrong' END AS verdict FROM n"""


@query("""WITH c AS (SELECT source, count(*) FILTER (n_chars > 500) AS made, count(*) FILTER (n_chars < 100) AS "schema", count(*) FILTER (n_chars BETWEEN 100 AND 500) AS duplicate FROM documents GROUP BY source)
  SELECT source, round(made / 100, 4)::DOUBLE AS yield_rate, made > 100 AS overproduced, CASE WHEN made + "schema" + duplicate > 0 THEN round("schema" / (made + "schema" + duplicate), 4) END::DOUBLE AS schema_rate,
  CASE WHEN made + "schema" + duplicate > 0 THEN round(duplicate / (made + "schema" + duplicate), 4) END::DOUBLE AS duplicate_rate FROM c""")
def generation_health(spark, sf_dir):
    from ..operators.guards import health

    n = F.col("n_chars")
    c = table(spark, sf_dir, "documents").groupBy("source").agg(F.count_if(n > 500).alias("made"), F.count_if(n < 100).alias("schema"), F.count_if(n.between(100, 500)).alias("duplicate"))
    return health(c.withColumn("asked", F.lit(100)), "asked", "made", ["schema", "duplicate"]).select("source", "yield_rate", "overproduced", "schema_rate", "duplicate_rate")


BASES["fallback_rate"] = f"""WITH {PAIRS} SELECT count(*) AS n, round(avg((b = '')::INT), 4) AS fallback_rate, round(avg((len(string_split(a, chr(10))) <> len(string_split(b, chr(10))))::INT), 4) AS mismatch_rate FROM pairs"""


#: Korean sentences that are woven in behind the texts, as the driver's tables hold none: one of each class of endings.
ENDED = ("보고합니다. ", "보내요. ", "검토함. ", "받았다. ")
_CLASSES = "['hapnida', 'haeyo', 'gaejosik', 'da']"


def _ended(spark, sf_dir) -> DataFrame:
    """Documents with three sentences of one class behind them and three of another."""
    kinds = F.array(*map(F.lit, ENDED))
    pick = lambda n: F.repeat(F.element_at(kinds, (n % 4 + 1).cast("int")), 3)
    text = F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), pick(F.col("doc_id")), pick(F.floor(F.col("doc_id") / 4)))
    return table(spark, sf_dir, "documents").withColumn("text", text)


@query(f"""SELECT doc_id, 6::BIGINT AS n, {_CLASSES}[doc_id % 4 + 1] AS front, {_CLASSES}[doc_id // 4 % 4 + 1] AS back, doc_id % 4 = doc_id // 4 % 4 AS consistent FROM documents""")
def ending_consistency(spark, sf_dir):
    from ..operators.guards import ending_consistency as endings

    return endings(_ended(spark, sf_dir), "doc_id", "text")


_ENDED_SQL = "coalesce(text, '') || chr(10) || repeat(['" + "', '".join(ENDED) + "'][doc_id % 4 + 1], 3) || repeat(['" + "', '".join(ENDED) + "'][doc_id // 4 % 4 + 1], 3) || CASE WHEN doc_id % 3 = 0 THEN '매우 ' ELSE '' END"


@query(f"""WITH t AS (SELECT doc_id, lang, {_ENDED_SQL} AS x FROM documents), s AS (SELECT doc_id, lang, {SENTENCES.format('x')} AS s FROM t)
SELECT doc_id, CASE WHEN lang = 'en' THEN 'objective' ELSE 'clear' END AS applied, coalesce(lang = 'en', false) AS forced, len(s)::INT AS n,
  round(len(list_filter(s, lambda y: regexp_matches(regexp_replace(y, '[ .!?…]+$', ''), '(?:습니다|합니다|입니다|됩니다)$'))) / len(s), 4)::DOUBLE AS ending_rate, (doc_id % 3 = 0)::INT AS forbidden FROM s""")
def tone_check(spark, sf_dir):
    from ..operators.guards import tone_check as check

    t = _ended(spark, sf_dir).withColumns({"tone": F.lit("clear"), "kind": F.when(F.col("lang") == "en", "debt_reason")})
    return check(t.withColumn("text", F.concat("text", F.when(F.col("doc_id") % 3 == 0, "매우 ").otherwise(""))), "doc_id", "text", "tone", "kind")


@query("""SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN NULL ELSE c_name END AS name, 'NEW' AS segment, CASE WHEN c_nationkey % 2 = 0 THEN 'name' ELSE '' END AS cleared FROM customer""")
def merged_values(spark, sf_dir):
    from ..functions.collections import cleared, merge_values

    state = F.create_map(F.lit("name"), F.col("c_name"), F.lit("segment"), F.col("c_mktsegment"))
    accepted = F.create_map(F.lit("segment"), F.lit("NEW"))
    clears = F.when(F.col("c_nationkey") % 2 == 0, F.array(F.lit("name"), F.lit("none"))).otherwise(F.array().cast("array<string>"))
    out = table(spark, sf_dir, "customer").select("c_custkey", merge_values(state, accepted, clears).alias("m"), F.array_join(cleared(state, accepted, clears), ",").alias("cleared"))
    return out.select("c_custkey", F.col("m")["name"].alias("name"), F.col("m")["segment"].alias("segment"), "cleared")


@query("""WITH l AS (SELECT doc_id, unnest(range(0, len(l)))::INT AS i, unnest(l) AS x, len(l)::BIGINT AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))
  SELECT doc_id, i AS i_chunk_on_doc, n AS n_chunk_of_doc, length(x)::INT AS n_char, (i // 10 + 1)::INT AS i_page, (i % 10)::INT AS i_chunk_on_page, least(10, n - i // 10 * 10)::BIGINT AS n_chunk_of_page, ((n - 1) // 10 + 1)::INT AS n_page FROM l""")
def chunk_records(spark, sf_dir):
    from ..operators.ordered import page_fields

    c = page_fields(_lines(spark, sf_dir), "doc_id", "pos", "section")
    n = F.count(F.lit(1)).over(Window.partitionBy("doc_id"))
    return c.select("doc_id", F.col("pos").alias("i_chunk_on_doc"), n.alias("n_chunk_of_doc"), F.length("text").alias("n_char"), "i_page", "i_chunk_on_page", "n_chunk_of_page", "n_page")
