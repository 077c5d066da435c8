"""Terms by character offset: words that the table of parts names, looked up in every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import terms
from .registry import query, table



@query("""WITH d AS (SELECT doc_id, trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '[\\s\\x0B]+', ' ', 'g')) AS x FROM documents WHERE text IS NOT NULL),
t AS (SELECT DISTINCT unnest(string_split(lower(text), ' ')) AS term FROM benchmark), w AS (SELECT term FROM t WHERE regexp_matches(term, '^[a-z]{5,}$') AND NOT regexp_matches(term, 's$')),
p AS (SELECT doc_id, unnest(regexp_extract_all(x, '[a-z0-9]+')) AS said FROM d),
f AS (SELECT said, arg_max(w.term, length(w.term)) AS term FROM (SELECT DISTINCT said FROM p) s JOIN w ON said = w.term OR said = w.term || 's' OR said = w.term || 'es' GROUP BY said)
SELECT doc_id, count(*)::BIGINT AS n_places, count(DISTINCT term)::BIGINT AS n_terms FROM p JOIN f USING (said) GROUP BY doc_id""")
def benchmark_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many places of every document hold a word of a benchmark item, in singular or plural, and how many such words."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.split(F.lower("text"), " ")).alias("term")).where("term RLIKE '^[a-z]{5,}$' AND NOT term RLIKE 's$'")
    found = terms.find_terms(table(spark, sf_dir, "documents"), "doc_id", "text", words)
    return terms.group_places(found, "doc_id").groupBy("doc_id").agg(F.sum("n").alias("n_places"), F.count(F.lit(1)).alias("n_terms"))
