"""A corpus from raw documents to token files: five operators, each stage written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.llm.decontaminate import remove_contaminated
from docloom.llm.mixing import mix_texts
from docloom.llm.quality_classifier import keep_good
from docloom.llm.shared import materialize
from docloom.llm.simhash import deduplicate
from docloom.llm.token_output import round_trip

TOKENIZER = "byte_bpe_50k.json"


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, doesn't reject.

    Each row is judged by its own text: null and empty texts as a text without
    words, repeated rows alike. A score equal to the threshold stays. No
    documents give none; without labels all stay.
    """
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one of smallest id, and of those the one of smallest text hash.

    Null and empty texts are one group. A row without an id stays only where
    its group has no id. No documents give none.
    """
    return deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none and stay, as do all documents where there
    are no items; rows without an id are told apart by their texts, and equal
    rows go together. A document that holds exactly 0.8 of an item goes.
    """
    return remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them, a row each.

    Null and empty texts have no words to take, so they go, as do documents of
    which no slot took a word. A null source is a source. No documents give
    none.
    """
    return mix_texts(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, and each document's place in them as read back, in order of id, null ids first.

    A null or empty text is the end id alone; rows of one id are written each.
    No documents give none.
    """
    import public_tokenizers

    return round_trip(spark, docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash", simhash),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_output", token_output),
]

#: SQL can't express the fitted scores or the tokenizer; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and reread as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
