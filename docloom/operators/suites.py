"""Evaluation suites: what is measured for a feature, against which target, and the verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import sampled

# Metrics of each feature, with their kind, what they need and their role.
METRICS = [
    ("template_fill", "field_extraction_score", "Text", "extraction_samples", "operational"),
    ("template_fill", "hwpx_fill_roundtrip", "Structure", "hwpx_before,hwpx_after", "operational"),
    ("template_fill", "hwpx_document_integrity", "Structure", "hwpx_before,hwpx_after", "operational"),
    ("template_fill", "hwpx_text_crosscheck", "Structure", "hwpx_before,hwpx_after", "operational"),
    ("template_fill", "multiturn_scenario_score", "Numeric", "scenarios", "operational"),
    ("template_fill", "pii_leak_count", "Text", "answers", "operational"),
    ("text_polish", "polish_structure_pass_rate", "Structure", "pairs", "operational"),
    ("text_polish", "tone_pass_rate", "Text", "pairs", "operational"),
    ("text_polish", "ending_consistency", "Text", "pairs", "operational"),
    ("text_polish", "fact_preservation_check", "Text/Numeric", "pairs", "operational"),
    ("text_polish", "sentence_length_stats", "Numeric", "pairs", "advisory"),
    ("text_polish", "pii_leak_count", "Text", "answers", "operational"),
    ("translation", "translation_structure_health", "Structure", "records", "operational"),
    ("translation", "fact_preservation_check", "Text/Numeric", "pairs", "operational"),
    ("translation", "glossary_compliance", "Text", "pairs,glossary", "operational"),
    ("translation", "chrf_score", "Numeric", "pairs.reference", "operational"),
    ("translation", "pii_leak_count", "Text", "answers", "operational"),
    ("faq", "grounding_overlap", "Text", "items", "screening"),
    ("faq", "faq_generation_health", "Numeric", "generation", "operational"),
    ("faq", "pii_leak_count", "Text", "answers", "operational"),
]
# Target of each metric's value; truth counts as 1.
TARGETS = [
    ("template_fill", "hwpx_fill_roundtrip.agreement_rate", "eq", 1.0),
    ("template_fill", "hwpx_document_integrity.passed", "eq", 1.0),
    ("template_fill", "hwpx_text_crosscheck.no_paragraph_loss", "eq", 1.0),
    ("template_fill", "multiturn_scenario_score.session_accuracy_rate", "eq", 1.0),
    ("template_fill", "multiturn_scenario_score.completion_rate", "gt", 0.9),
    ("template_fill", "field_extraction_score.overall.f1", "gt", 0.8),
    ("template_fill", "field_extraction_score.hallucination.rate", "lt", 0.05),
    ("template_fill", "pii_leak_count.leak_count", "eq", 0.0),
    ("text_polish", "polish_structure_pass_rate.pass_rate", "eq", 1.0),
    ("text_polish", "fact_preservation_check.pass_rate", "eq", 1.0),
    ("text_polish", "tone_pass_rate.pass_rate", "gt", 0.9),
    ("text_polish", "ending_consistency.consistent_rate", "gt", 0.9),
    ("text_polish", "pii_leak_count.leak_count", "eq", 0.0),
    ("translation", "translation_structure_health.fallback_rate", "eq", 0.0),
    ("translation", "translation_structure_health.segment_mismatch_rate", "eq", 0.0),
    ("translation", "fact_preservation_check.pass_rate", "eq", 1.0),
    ("translation", "glossary_compliance.mean_compliance_rate", "gt", 0.95),
    ("translation", "pii_leak_count.leak_count", "eq", 0.0),
    ("faq", "faq_generation_health.yield_rate", "gt", 0.8),
    ("faq", "faq_generation_health.rejection_rates.schema", "lt", 0.1),
    ("faq", "pii_leak_count.leak_count", "eq", 0.0),
]


def metric_catalog(spark: SparkSession) -> DataFrame:
    """(feature, metric, tag, needs, role): every metric, a row each."""
    return spark.createDataFrame(METRICS, "feature string, metric string, tag string, needs string, role string")


def targets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TARGETS, "feature string, path string, operator string, value double")


def suites(spark: SparkSession) -> DataFrame:
    """(feature, n_metrics, n_operational, n_targets): one row a suite."""
    made = metric_catalog(spark).groupBy("feature").agg(F.count(F.lit(1)).alias("n_metrics"), F.count_if(F.col("role") == "operational").alias("n_operational"))
    return made.join(targets(spark).groupBy("feature").agg(F.count(F.lit(1)).alias("n_targets")), "feature")


def check_targets(measured: DataFrame, wanted: DataFrame, run: str = "run") -> DataFrame:
    """(run, feature, path, status): each target of each run of a feature against (run, feature, path, actual).

    A value that is missing or null is not measured. Thresholds of a run's own
    stand in ``threshold``, if ``measured`` has that column.
    """
    own = F.col("threshold") if "threshold" in measured.columns else F.lit(None).cast("double")
    given = measured.select(run, "feature", F.col("path").alias("_path"), F.col("actual").cast("double").alias("actual"), own.alias("_own"))
    due = given.select(run, "feature").distinct().join(F.broadcast(wanted), "feature")  # the targets are a fixed table
    met = due.join(given.withColumnRenamed("_path", "path"), [run, "feature", "path"], "left")
    limit = F.coalesce("_own", "value")
    ok = F.when(F.col("operator") == "eq", F.col("actual") == limit).when(F.col("operator") == "gt", F.col("actual") > limit).otherwise(F.col("actual") < limit)
    status = F.when(F.col("actual").isNull(), "not_measured").when(ok, "pass").otherwise("fail")
    return met.select(run, "feature", "path", "operator", limit.alias("limit"), "actual", status.alias("status"))


def verdicts(checks: DataFrame, run: str = "run") -> DataFrame:
    """(run, feature, verdict, n_passed, n_failed, n_not_measured): a fail outweighs what wasn't measured, and that a pass."""
    n = {s: F.count_if(F.col("status") == s) for s in ("pass", "fail", "not_measured")}
    verdict = F.when(n["fail"] > 0, "fail").when(n["pass"] == 0, "not_measured").when(n["not_measured"] > 0, "pass_but_incomplete").otherwise("pass")
    return checks.groupBy(run, "feature").agg(verdict.alias("verdict"), n["pass"].alias("n_passed"), n["fail"].alias("n_failed"), n["not_measured"].alias("n_not_measured"))


def skipped(given: DataFrame, catalog: DataFrame, run: str = "run") -> DataFrame:
    """(run, feature, metric, missing): metrics whose inputs (run, feature, inputs: array) lack something, and what."""
    met = given.join(F.broadcast(catalog), "feature")
    missing = F.array_except(F.split("needs", ","), "inputs")
    return met.select(run, "feature", "metric", F.array_join(missing, ",").alias("missing")).where("missing <> ''")


def gate(items: DataFrame, key: str, passed: Column, similarity: Column, open_: bool, threshold: float = 0.8, rate: float = 0.1, salt: str = "gate") -> DataFrame:
    """(key, outcome, reason, judged): which items a judge may see.

    Items that failed, or passed with a low similarity, are candidates; others
    are screened out. Of the candidates a fixed sample is judged, if the gate
    is open at all.
    """
    reason = (
        F.when(~F.coalesce(passed, F.lit(False)), "deterministic_failed")
        .when(similarity.isNull(), "deterministic_passed")
        .when(similarity >= threshold, "embedding_passed")
        .otherwise("low_similarity")
    )
    candidate = reason.isin("deterministic_failed", "low_similarity")
    return items.select(key, F.when(candidate, "candidate").otherwise("screened_out").alias("outcome"), reason.alias("reason"), (candidate & F.lit(open_) & sampled(F.col(key), rate, salt)).alias("judged"))


def pass_rate(scored: DataFrame, passed: Column) -> DataFrame:
    """(items, scored, pass_rate): over rows that could be scored; a null ``passed`` counts in items only. Null without scored rows."""
    n = F.count(passed)
    return scored.agg(F.count(F.lit(1)).alias("items"), n.alias("scored"), F.round(F.count_if(passed) / F.nullif(n, F.lit(0)), 4).alias("pass_rate"))


def mean_of(scored: DataFrame, value: Column, places: int = 4) -> DataFrame:
    """(items, measurable, mean, least, most): of a value, nulls left out."""
    return scored.agg(F.count(F.lit(1)).alias("items"), F.count(value).alias("measurable"), F.round(F.avg(value), places).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"))
