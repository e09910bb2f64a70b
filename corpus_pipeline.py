"""From documents to token ids, in stages.

Each stage takes what its predecessor kept, as rows of ``documents``, and
returns the rows it keeps, changed where that is its decision; the last
returns the ids. ``run`` applies them to the ``documents`` table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import decontaminate, near_dedup, piece_codec, quality_rules, queries, secret_scan


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return near_dedup.representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth of the words is benchmark text go."""
    return decontaminate.clean(docs, queries.table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced; all documents stay."""
    return secret_scan.redact(docs, queries.ranks(), queries.split_pattern())


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang and the ids of each text."""
    return piece_codec.encode(docs, queries.tokenizer_file("piece_bpe_32k.model"), keep=["lang", "source"])


STAGES = [
    ("quality_rules", rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secrets),
    ("piece_codec", encoding),
]

#: The stages cannot be written in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
