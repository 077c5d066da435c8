"""The same results in DuckDB SQL, where SQL can express them.

Not here: fingerprints need XXH64 with a seed (2), fitted scores (4, 9), the
tokenizer (5, 13), the pseudorandom draw of blocks (7) and eigenvectors (11). The tests hold those
against brute force, a round trip or held-out labels.
"""

BLANKS = "[\\x20\\x09-\\x0D]+"
ANY_WORD = "[^\\x20\\x09-\\x0D]"

OP1 = f"""WITH t AS (SELECT page_id, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '') AS host,
  list_filter(list_transform(string_split(regexp_replace(coalesce(html, ''), '<[^>]*>', chr(10), 'g'), chr(10)),
    lambda x: trim(regexp_replace(x, '{BLANKS}', ' ', 'g'))), lambda x: x <> '') AS lines FROM pages),
n AS (SELECT host, count(*) AS pages FROM t GROUP BY host),
c AS (SELECT host, x, count(*) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS x FROM t) GROUP BY host, x),
d AS (SELECT c.host, list(x) AS gone FROM c JOIN n ON c.host IS NOT DISTINCT FROM n.host
  WHERE c.n >= 3 AND c.n > 0.3::DOUBLE * n.pages GROUP BY c.host),
k AS (SELECT page_id, t.host, lines, CASE WHEN gone IS NULL THEN lines ELSE list_filter(lines, lambda x: NOT list_contains(gone, x)) END AS kept
  FROM t LEFT JOIN d ON t.host IS NOT DISTINCT FROM d.host)
SELECT page_id, host, len(lines)::BIGINT AS n_lines, (len(lines) - len(kept))::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(kept, chr(10)), '')) AS kept_sha256 FROM k"""

OP3 = f"""WITH t AS (SELECT doc_id, source AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '{BLANKS}'), lambda x: x <> '') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{ANY_WORD}')) AS lines FROM t),
p AS (SELECT doc_id, unnest(words) AS a, generate_subscripts(words, 1) AS i FROM w),
q AS (SELECT doc_id, i, a, lead(a, 1) OVER o AS b, lead(a, 2) OVER o AS c FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM q WHERE c IS NOT NULL),
r AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + o AS pos FROM g, (SELECT unnest([0, 1, 2]) AS o) WHERE g.n > 1) GROUP BY doc_id),
l AS (SELECT doc_id, host, trim(regexp_replace(lower(x), '{BLANKS}', ' ', 'g')) AS line, len(list_filter(string_split_regex(x, '{BLANKS}'), lambda y: y <> '')) AS n
  FROM (SELECT doc_id, host, unnest(lines) AS x FROM w)),
often AS (SELECT host, line FROM l GROUP BY host, line HAVING count(DISTINCT doc_id) > 20),
gone AS (SELECT doc_id, sum(n) AS n FROM l JOIN often o ON l.host IS NOT DISTINCT FROM o.host AND l.line = o.line GROUP BY doc_id),
s AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '{BLANKS}', '', 'g'))::BIGINT AS word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
  coalesce(r.n, 0)::BIGINT AS n_repeat_words, coalesce(gone.n, 0)::BIGINT AS n_boilerplate_words
  FROM w LEFT JOIN r USING (doc_id) LEFT JOIN gone USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT 100 * (n_words - n_boilerplate_words) < 30 * n_words AS kept, n_boilerplate_words FROM f"""

OP6 = f"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '{BLANKS}'), lambda x: x <> '') AS words FROM documents),
p AS (SELECT doc_id, len(words) AS n, unnest(words) AS a, generate_subscripts(words, 1) AS i FROM w),
h AS (SELECT doc_id, n, i, md5(string_agg(a, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)) AS h FROM p),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS lowest FROM h WHERE i <= n - 12),
c AS (SELECT DISTINCT doc_id, i + o AS i FROM m, (SELECT unnest(range(0, 13)) AS o) WHERE lowest < doc_id),
k AS (SELECT doc_id, string_agg(a, ' ' ORDER BY i) AS kept, count(*) AS n FROM p ANTI JOIN c USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)"""

OP8 = """WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
n AS (SELECT *, length(text) + length(text) - length(replace(text, '\\', '')) AS body, length(role) + length(role) - length(replace(role, '\\', '')) AS name,
  lag(role) OVER o AS last, row_number() OVER o AS pos FROM t WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (7 + sum(body + CASE WHEN last = role THEN 8 WHEN last IS NULL THEN 16 + name ELSE 23 + name END))::BIGINT AS formatted_chars
FROM n GROUP BY conv_id"""


def _shingles(table: str, key: str) -> str:
    """Distinct (key, s): 5-word shingles of a table's texts; a shorter text is one."""
    return f"""(SELECT DISTINCT {key}, s FROM (SELECT {key}, i, n, string_agg(a, ' ') OVER (PARTITION BY {key} ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS s
  FROM (SELECT {key}, len(words) AS n, unnest(words) AS a, generate_subscripts(words, 1) AS i FROM
    (SELECT {key}, list_filter(string_split_regex(lower(coalesce(text, '')), '{BLANKS}'), lambda x: x <> '') AS words FROM {table})))
  WHERE i <= greatest(n - 4, 1))"""


OP10 = f"""WITH d AS {_shingles('documents', 'doc_id')}, t AS {_shingles('benchmark', 'item_id')},
n AS (SELECT item_id, count(*) AS n FROM t GROUP BY item_id),
m AS (SELECT doc_id, item_id, count(*) AS shared FROM d JOIN t USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n.n::INT AS n_shingles, shared::INT AS n_shared FROM m JOIN n USING (item_id) WHERE 1000 * shared >= 800 * n.n"""

OP12 = f"""WITH h AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id) AS h FROM documents),
u AS (SELECT doc_id, text, regexp_extract_all(text, '[\\x20\\x09-\\x0D]*{ANY_WORD}+|{BLANKS}') AS u,
  ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM h),
c AS (SELECT *, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
  CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix FROM c)
SELECT doc_id, len(u)::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p"""

ORACLES = {
    "op1_line_dedup": OP1,
    "op3_quality_rules": OP3,
    "op6_substring_dedup": OP6,
    "op8_chat_format": OP8,
    "op10_decontaminate": OP10,
    "op12_fill_in_middle": OP12,
}
