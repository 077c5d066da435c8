"""Markdown as literals and translatable units, its structure, and marks in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.collections import prefix
from ..functions.text import let

# The line forms of Markdown, and tables and tags of HTML in it.
TABLE, TAG = "(?is)<table\\b.*?</table\\s*>", "(?s)<!--.*?-->|<[^>]+>"
FENCE = "(?s)^\\s*(?:```|~~~).*"
SEPARATOR = "^\\s*\\|?(?:\\s*:?-+:?\\s*\\|)+\\s*:?-*:?\\s*\\|?\\s*$"
TAG_LINE = "^\\s*(?:</?[A-Za-z][^>]*/?>|<!--.*?-->)+\\s*$"
HEADING, QUOTE, ITEM = "(?s)^(#{1,6}\\s+)(.*)\\z", "(?s)^(\\s*(?:>\\s?)+)(.*)\\z", "(?s)^(\\s*(?:[-*+]|\\d{1,3}[.)])\\s+)(.*)\\z"
BAR = "(?<!\\\\)\\|"
#: What a regular expression's blank is by Unicode.
BLANKS = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
SEGMENT = "array<struct<kind:string,type:string,text:string>>"


def _lit(text: Column) -> Column:
    return F.struct(F.lit("lit").alias("kind"), F.lit(None).cast("string").alias("type"), text.alias("text"))


def _piece(text: Column, kind: Column | str, unit=lambda x: x) -> Column:
    """Segments of a text: its letters make it a unit, the blanks around it literals; without letters it is one literal."""
    name = F.lit(kind) if isinstance(kind, str) else kind

    def cut(t: Column) -> Column:
        # a text with letters isn't blank, so what is trimmed on one side is not on the other
        left, right = F.ltrim(t, F.lit(BLANKS)), F.rtrim(t, F.lit(BLANKS))
        lead, trail = F.length(t) - F.length(left), F.length(t) - F.length(right)
        body = lambda: F.struct(F.lit("unit").alias("kind"), name.alias("type"), unit(F.btrim(t, F.lit(BLANKS))).alias("text"))
        around = F.array(_lit(F.substring(t, F.lit(1), lead)), body(), _lit(F.right(t, trail)))
        parts = F.when((lead == 0) & (trail == 0), F.array(body())).otherwise(F.filter(around, lambda s: s["text"] != ""))
        return F.when(t.rlike("\\p{L}"), parts).otherwise(F.array(_lit(t)))

    return let(text, cut)


def _unescape(text: Column) -> Column:
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return text


def _joined(parts: Column, between: str, make) -> Column:
    """Segments of each part, with a literal between them."""
    return F.flatten(F.transform(parts, lambda p, i: F.concat(F.when(i > 0, F.array(_lit(F.lit(between)))).otherwise(F.array().cast(SEGMENT)), make(p))))


def _line_segments(line: Column) -> Column:
    """Segments of a line outside code."""

    def marked(shape: str, kind: str) -> Column:
        return F.concat(F.array(_lit(F.regexp_extract(line, shape, 1))), _piece(F.regexp_extract(line, shape, 2), kind))

    cells = _joined(F.split(line, BAR, -1), "|", lambda c: _piece(c, "table_cell"))
    plain = ~line.rlike("\\S") | line.rlike(TAG_LINE)
    return (
        F.when(plain, F.array(_lit(line)))
        .when(line.rlike("^\\s*\\|"), F.when(line.rlike(SEPARATOR), F.array(_lit(line))).otherwise(cells))
        .when(line.rlike(HEADING), marked(HEADING, "heading"))
        .when(line.rlike(QUOTE), marked(QUOTE, "blockquote"))
        .when(line.rlike(ITEM), marked(ITEM, "list_item"))
        .otherwise(_piece(line, "paragraph"))
    )


def _table_segments(table: Column) -> Column:
    """Segments of an HTML table: tags are literals, what stands between them is units line by line."""
    tags, between = F.regexp_extract_all(table, F.lit(TAG), F.lit(0)), F.split(table, TAG, -1)
    text = lambda t: _joined(F.split(t, "\n"), "\n", lambda p: _piece(p, "html_table_text", _unescape))
    both = F.arrays_zip(between.alias("b"), tags.alias("t"))
    return F.flatten(F.transform(both, lambda x: F.concat(text(x["b"]), F.when(x["t"].isNotNull(), F.array(_lit(x["t"]))).otherwise(F.array().cast(SEGMENT)))))


def _lines_of(text: Column) -> Column:
    """Array of (region, line, text, is_table, code): HTML tables whole, and the lines around them, each region from outside code."""

    def region(given: Column, at: Column, is_table: bool) -> Column:
        line = lambda x, i, code: F.struct(at.alias("region"), i.alias("line"), x.alias("text"), F.lit(is_table).alias("is_table"), code.alias("code"))
        if is_table:
            return F.array(line(given, F.lit(0), F.lit(False)))
        # a region without fences, as most are, needs no running count
        open_ = lambda fences: F.when(F.exists(fences, lambda f: f), prefix(fences, F.lit(False), lambda a, b: a != b))
        of = lambda some, fences, before: F.transform(some, lambda x, i: line(x, i, F.get(fences, i) | F.coalesce(F.get(before, i), F.lit(False))))
        return let(F.split(given, "\n", -1), lambda some: let(F.transform(some, lambda x: x.rlike(FENCE)), lambda fences: let(open_(fences), lambda before: of(some, fences, before))))

    def cut(x: Column) -> Column:
        tables, between = F.regexp_extract_all(x, F.lit(TABLE), F.lit(0)), F.split(x, TABLE, -1)
        none = F.array().cast("array<struct<region:int,line:int,text:string,is_table:boolean,code:boolean>>")
        some = lambda r, i, c, n, whole: F.when(r[c].isNotNull(), region(r[c], 2 * i + n, whole)).otherwise(none)
        return F.flatten(F.transform(F.arrays_zip(between.alias("b"), tables.alias("t")), lambda r, i: F.concat(some(r, i, "b", 0, False), some(r, i, "t", 1, True))))

    return let(F.coalesce(text, F.lit("")), cut)


def lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(row, key, region, line, is_table, text, code): HTML tables whole, and the lines around them.

    ``row`` numbers the rows of ``docs``, so that texts which share a key, or have
    none, stay apart. ``code`` tells fences and what they hold; each region starts outside code. A
    null text is one empty line, as an empty one is. A text is cut where it is, and nothing is shuffled.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), key, _lines_of(F.col(text)).alias("x"))  # numbered before they are spread
    return rows.select("row", key, F.explode_outer("x").alias("x")).select("row", key, "x.region", "x.is_table", "x.line", "x.text", "x.code")


def _segments_of(text: Column) -> Column:
    """Array of (region, line, seg, kind, type, text, context, unit): a text's literals, and its units in order."""
    heading = lambda x: ~x["is_table"] & ~x["code"] & x["text"].rlike(HEADING)

    def of_line(x: Column, context: Column) -> Column:
        made = let(x["text"], lambda t: F.when(x["is_table"], _table_segments(t)).when(x["code"], F.array(_lit(t))).otherwise(_line_segments(t)))
        feed = F.when(~x["is_table"] & (x["line"] > 0), F.array(_lit(F.lit("\n")))).otherwise(F.array().cast(SEGMENT))
        # a text's first line stays, even if it is empty, so that no text is lost
        first = lambda s: F.when((F.size(s) == 0) & (x["region"] == 0) & (x["line"] == 0), F.array(_lit(F.lit("")))).otherwise(s)
        after = lambda s: F.when(s["kind"] == "unit", F.when(s["type"] == "heading", "").otherwise(F.coalesce(context, F.lit(""))))
        whole = lambda s, i: F.struct(x["region"].alias("region"), x["line"].alias("line"), i.alias("seg"), s["kind"].alias("kind"), s["type"].alias("type"), s["text"].alias("text"), after(s).alias("context"))
        return F.transform(let(F.filter(F.concat(feed, made), lambda s: s["text"] != ""), first), whole)

    def numbered(segments: Column) -> Column:
        names = ("region", "line", "seg", "kind", "type", "text", "context")
        of = lambda s, i: F.struct(*[s[n].alias(n) for n in names], i.cast("long").alias("unit"))
        units = F.transform(F.filter(segments, lambda s: s["kind"] == "unit"), of)
        return F.concat(units, F.transform(F.filter(segments, lambda s: s["kind"] != "unit"), lambda s: of(s, F.lit(None))))

    def cut(every: Column) -> Column:
        heads = F.transform(every, lambda x: F.when(heading(x), F.trim(F.regexp_extract(x["text"], HEADING, 2))))
        contexts = let(heads, lambda h: F.when(F.exists(h, lambda x: x.isNotNull()), prefix(h, F.lit(None).cast("string"), lambda a, b: F.coalesce(b, a))))
        return let(contexts, lambda c: let(F.flatten(F.transform(every, lambda x, i: of_line(x, F.get(c, i)))), numbered))

    return let(_lines_of(text), cut)


def split_units(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(row, key, region, line, seg, kind, type, text, context, unit): a text's literals and units, in order by region, line and seg.

    Joined in order the segments are the text, but for entities of units in
    HTML tables, which ``rebuild`` writes again. ``unit`` numbers the units of
    a text from 0; ``context`` is the last heading before a unit's line.
    ``row`` numbers the rows of ``docs``: each is cut by itself, where it is, whether keys repeat
    or are null; nothing is shuffled. A null or empty text is one empty literal.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), key, _segments_of(F.col(text)).alias("x"))
    # no text is without segments; a plain explode would first cut each text once more, to filter those that are
    return rows.select("row", key, F.explode_outer("x").alias("x")).select("row", key, "x.*")


def rebuild(segments: DataFrame, translations: DataFrame, key: str) -> DataFrame:
    """(key, text): segments in order, units by their ``translated`` of (key, unit, translated), or as they were; one row a row that was split.

    Line feeds of a translation become blanks; bars of a table cell and signs
    of HTML are escaped, so that the structure stays. Null keys are a key like any other;
    texts that share a key share its translations; of several translations of a unit the smallest counts.
    Segments and translations of a key meet in one partition, with no more than what the text is made of. Where the documents were
    dealt by key before they were cut, and the translations come from them, they are there already, and nothing is shuffled.
    """
    mark = F.when(F.col("type").isin("html_table_text", "table_cell"), F.col("type"))
    parts = segments.select(key, F.when(F.col("kind") == "unit", F.col("unit")).alias("unit"), "row", "region", "line", "seg", mark.alias("type"), "text")
    said = translations.where("translated IS NOT NULL AND unit IS NOT NULL").select(key, "unit", F.col("translated").alias("text"))
    both = parts.unionByName(said, allowMissingColumns=True)
    # a unit's translations have no row, so they come before its segments, the smallest of them last
    so_far = Window.partitionBy(key).orderBy("unit", F.asc_nulls_first("row"), F.desc("text")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(F.col("row").isNull(), F.struct("unit", "text")), ignorenulls=True).over(so_far)
    met = both.withColumn("last", last).where("row IS NOT NULL").withColumn("translated", F.when(F.col("last.unit") == F.col("unit"), F.col("last.text")))
    said = F.regexp_replace(F.coalesce("translated", "text"), "\r?\n", " ")
    html = F.replace(F.replace(F.regexp_replace(said, "&(?!#?\\w+;)", "&amp;"), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    said = F.when(F.col("type") == "html_table_text", html).when(F.col("type") == "table_cell", F.regexp_replace(said, BAR, "\\\\|")).otherwise(said)
    piece = F.struct("region", "line", "seg", F.when(F.col("unit").isNotNull(), said).otherwise(F.col("text")).alias("x"))
    pieces = F.sort_array(F.collect_list(piece))
    return met.groupBy("row", key).agg(F.array_join(F.transform(pieces, lambda p: p["x"]), "").alias("text")).drop("row")


PARTS = ("headings", "table_rows", "separator_rows", "fences", "html_tables")


def _structure(rows: DataFrame, by: list[str]) -> DataFrame:
    """The structure of ``lines``, summed by row and key."""
    x = F.col("text")
    count = lambda shape: F.regexp_count(x, F.lit(shape))
    body, row = ~F.col("is_table") & ~F.col("code"), x.rlike("^\\s*\\|")
    level = F.when(body & F.trim(x).rlike("^#{1,6}\\s"), F.length(F.regexp_extract(F.trim(x), "^(#+)", 1)))
    apart = body & row & x.rlike(SEPARATOR)
    in_order = lambda v: F.transform(F.sort_array(F.collect_list(F.when(v.isNotNull(), F.struct("region", "line", v.alias("v"))))), lambda p: p["v"])
    sizes = F.when(F.col("is_table"), F.concat_ws("x", count("(?i)<tr\\b"), count("(?i)<t[dh]\\b")))
    return rows.groupBy(*by).agg(
        in_order(level).alias("headings"),
        in_order(F.when(body & row & ~x.rlike(SEPARATOR), count(BAR) - 1)).alias("table_rows"),
        F.count_if(apart).alias("separator_rows"),
        F.count_if(~F.col("is_table") & x.rlike(FENCE)).alias("fences"),
        in_order(sizes).alias("html_tables"),
    )


def structure(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, headings, table_rows, separator_rows, fences, html_tables): levels and columns in order, and counts; one row a row of ``docs``.

    Null and empty texts have no structure. Rows that share a key, or have none, stay apart.
    """
    return _structure(lines(docs, key, text), ["row", key]).drop("row")


def structure_issues(pairs: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """(key, issues, passed): parts of the structure that differ between two texts; one row a row of ``pairs``.

    Null texts are empty. Rows that share a key, or have none, are compared each by their own texts: both leave
    their row together, so nothing is joined.
    """
    sides = F.explode(F.array(*[F.struct(F.lit(i).alias("side"), F.coalesce(F.col(c), F.lit("")).alias("t")) for i, c in enumerate((before, after))]))
    rows = pairs.select(F.monotonically_increasing_id().alias("pair"), F.col(key).alias("given"), before, after).select("pair", "given", sides.alias("x"))
    rows = rows.select(F.struct("pair", "given", "x.side").alias("of"), F.col("x.t").alias("t"))
    both = _structure(lines(rows, "of", "t"), ["of"])
    part = lambda side: F.max(F.when(F.col("of.side") == side, F.struct(*PARTS)))
    met = both.groupBy("of.pair", "of.given").agg(part(0).alias("a"), part(1).alias("b"))
    off = {n: F.col(f"a.{n}") != F.col(f"b.{n}") for n in PARTS}
    issues = F.array_compact(F.array(
        F.when(off["table_rows"] | off["separator_rows"], "markdown_table"), F.when(off["html_tables"], "html_table"),
        F.when(off["headings"], "heading"), F.when(off["fences"], "code_fence"),
    ))
    return met.select(F.col("given").alias(key), issues.alias("issues"), (F.size(issues) == 0).alias("passed"))


def merge_spans(spans: Column) -> Column:
    """Sorted half-open (start, end) spans; those that overlap or touch are one."""

    def of(given: Column) -> Column:
        # how far the spans before each one reach, and with one more at the end how far all reach
        reach = prefix(F.transform(given, lambda s: s["end"]), F.lit(-1), lambda a, b: F.greatest(a, b))
        last = F.coalesce(F.array_max(F.transform(given, lambda s: s["end"])), F.lit(-1))
        return let(F.concat(reach, F.array(last)), lambda far: let(F.filter(F.sequence(F.lit(0), F.size(given)), lambda i: (i == F.size(given)) | (F.get(given, i)["start"] > F.get(far, i))), lambda firsts: cut(given, far, firsts)))

    def cut(given: Column, far: Column, firsts: Column) -> Column:
        return F.zip_with(F.slice(firsts, F.lit(1), F.size(firsts) - 1), F.slice(firsts, F.lit(2), F.size(firsts) - 1), lambda a, b: F.struct(F.get(given, a)["start"].alias("start"), F.get(far, b).alias("end")))

    return let(F.sort_array(spans), of)


def protected(text: Column) -> Column:
    """Array of (start, end): code fences with what they hold, an open one to the end, and HTML tags."""
    from .pii import places

    fences, tags = places(text, "(?m)^[^\\S\n]*```[^\n]*(?:\n(?:(?!\\s*```)[^\n]*(?:\n|\\z))*(?:[^\\S\n]*```[^\n]*(?:\n|\\z))?|\\z)"), places(text, "<[^<>\n]{0,300}>")
    return F.transform(F.concat(fences, tags), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))


def highlight(text: Column, spans: Column) -> Column:
    """The text with ``<mark>`` around the given (start, end) spans, joined where they meet; those in code or tags are left out."""

    def of(t: Column) -> Column:
        guard = protected(t)
        good = F.filter(spans, lambda s: (s["start"] >= 0) & (s["start"] < s["end"]) & (s["end"] <= F.length(t)))
        good = let(guard, lambda g: F.filter(good, lambda s: ~F.exists(g, lambda p: (s["start"] < p["end"]) & (p["start"] < s["end"]))))
        return let(merge_spans(F.transform(good, lambda s: F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end")))), lambda m: write(t, m))

    def write(t: Column, merged: Column) -> Column:
        starts = F.concat(F.array(F.lit(0)), F.transform(merged, lambda s: s["end"]))
        pieces = F.transform(starts, lambda a, i: F.concat(
            F.substring(t, a + 1, F.coalesce(F.get(merged, i)["start"], F.length(t)) - a),
            F.coalesce(F.concat(F.lit("<mark>"), F.substring(t, F.get(merged, i)["start"] + 1, F.get(merged, i)["end"] - F.get(merged, i)["start"]), F.lit("</mark>")), F.lit("")),
        ))
        return F.array_join(pieces, "")

    return let(text, of)
