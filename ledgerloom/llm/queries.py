"""The registered query of each operator: it applies the operator to its whole
table and derives the stated digest columns from the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import (decontaminate, fill_middle, importance, license_scan, near_dedup, piece_codec, quality_model, quality_rules, secret_scan, substring_dedup,
                            suffix_dedup, warc, word_codec)
from ledgerloom.llm.oracles import ORACLE  # noqa: F401 - registered with the queries


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def piece_model() -> str:
    return tokenizer_file("piece_bpe_32k.model")


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), width=50, digest=True)


def ranks() -> bytes:
    return secret_scan.vocabulary(tokenizer_file("byte_bpe_50k.tiktoken"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"), ranks(), split_pattern(), digest=True)


def op4_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encode(table(spark, sf_dir, "documents"), piece_model(), digest=True)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op6_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_licenses, licenses (sorted ids), spans (license:start:end by start)."""
    found = license_scan.scan(table(spark, sf_dir, "documents"))
    spans = F.transform("found", lambda f: F.concat_ws(":", f["license"], f["start"].cast("string"), f["end"].cast("string")))
    return found.select("doc_id", F.size("found").cast("long").alias("n_licenses"),
                        F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda f: f["license"]))), ",").alias("licenses"),
                        F.array_join(spans, ",").alias("spans"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), width=200, digest=True)


def op11_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=5, min_words=20, seed=42)


def op12_word_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_codec.encode(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), digest=True)


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.fill_in_middle(table(spark, sf_dir, "documents"), seed=1, rate=90, spm=20, digest=True)


QUERIES = {f.__name__: f for f in (op1_near_dedup, op2_substring_dedup, op3_secret_scan, op4_piece_codec, op5_warc, op6_quality_model, op7_quality_rules,
                                   op8_decontaminate, op9_license_scan, op10_suffix_dedup, op11_importance_resample, op12_word_codec, op13_fill_middle)}
