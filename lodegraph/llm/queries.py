"""The queries of this package for __spark_entry__.py: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, filter_audit, hard_negatives, langid, licenses, mixing, quality, rules, simhash, suffix_dedup, token_counts, token_output


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_output.token_output(_documents(spark, sf_dir), tokenizer_path=_vocabulary(), end_id=2)
    return out.select("doc_id", "start", "n_tokens", "ids_crc32")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(_documents(spark, sf_dir), length=100).drop("kept")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_documents(spark, sf_dir), shingle=3)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(_documents(spark, sf_dir), weights=(5, 2, 1), share=1.5, most=2)
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_documents(spark, sf_dir), tokenizer_path=_vocabulary(), rule="largest")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.decontaminate(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest", "longest_item", "longest_at")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_documents(spark, sf_dir))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_documents(spark, sf_dir))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.apply_rules(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), stratum="lang", alpha=0.05, delta=0.05)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.7)


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.formatted_digests(chat.with_control(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = hard_negatives.relabelled(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return hard_negatives.hard_negatives(vectors, every=100, step=256, positives=5, negatives=10, low=30, high=90)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), part="lang")


def queries() -> dict:
    return {f.__name__: f for f in (op1_token_output, op2_quality_rules, op3_suffix_dedup, op4_simhash, op5_mixing, op6_token_counts, op7_decontaminate, op8_license_scan, op9_language_id, op10_quality_score, op11_chat_format, op12_hard_negatives, op13_filter_audit)}


def oracle_sql() -> dict[str, str]:
    return {"op8_license_scan": licenses.scan_sql(), "op11_chat_format": chat.digests_sql(), "op12_hard_negatives": hard_negatives.hard_negatives_sql(), "op13_filter_audit": filter_audit.audit_sql()}
