"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .oracles import ORACLES




def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import line_dedup

    out = line_dedup(_table(spark, sf_dir, "pages"))
    return out.select("page_id", "host", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import hex_fingerprint, near_duplicates

    out = near_duplicates(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", hex_fingerprint("fp").alias("fingerprint"), "component_id")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import score_rules

    return score_rules(_table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_classifier import classify

    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_output import round_trip

    return round_trip(spark, _table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import remove_repeats

    out = remove_repeats(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    out = mix(_table(spark, sf_dir, "documents"))
    pieces = F.coalesce("pieces", F.array().cast("array<struct<shard:int,slot:bigint,from:bigint,to:bigint>>"))
    taken = F.aggregate(pieces, F.lit(0).cast("long"), lambda acc, x: acc + x["to"] - x["from"])
    return out.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat_format import format_chats, read_loss, read_turns

    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    chats = format_chats(turns.unionByName(extra))
    chats = chats.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), F.array_join(read_loss(F.col("formatted"), F.col("loss_spans")), "").alias("loss"))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_scoring import score_documents

    return score_documents(_table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contained_items

    return contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import by_component, whiten

    return by_component(whiten(_table(spark, sf_dir, "embeddings"))).withColumn("deviation", F.col("deviation").cast("long"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fill_in_middle import fill_in_middle, restore

    out = fill_in_middle(_table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import decode, encode

    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    out = decode(encode(_table(spark, sf_dir, "documents"), tokenizer), tokenizer)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_line_dedup,
        op2_simhash,
        op3_quality_rules,
        op4_quality_classifier,
        op5_token_output,
        op6_substring_dedup,
        op7_mixing,
        op8_chat_format,
        op9_lm_scoring,
        op10_decontaminate,
        op11_whitening,
        op12_fill_in_middle,
        op13_bpe,
    )
}
__all__ = ["ORACLES", "QUERIES"]
