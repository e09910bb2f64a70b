"""Vocabulary tables and token <-> id lookups.

A vocabulary is a DataFrame ``(token STRING, id INT, is_special BOOLEAN)``.
Special tokens come first in a fixed order; learned tokens follow.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.encode import AMOUNT, AMOUNT_EDGES, AMOUNT_RANGES_6, DAY, MONTH, PAD, SEP, UNK, WEEKDAY
from ledgerloom.operators.joins import bucketed, lookup_in_arrays, travels
from ledgerloom.operators.ranking import global_index

# ---------------------------------------------------------------------------
# Special-token catalogs of the three pipeline variants.
# "binned": [PAD] [UNK], sign, 21 amount bins, 12 months, 31 days, 7 weekdays, [SEP]
# "spaced":  [PAD] [UNK], origin, sign, 6 amount ranges, months, days, weekdays, [SEP]
# "tagged":      <PAD> <SOS> <EOS> <EOT> <UNK>
TAGGED_SPECIALS = ["<PAD>", "<SOS>", "<EOS>", "<EOT>", "<UNK>"]
ORIGIN_TOKENS = ["<account>", "<card>"]
SIGN_TOKENS = ["<INFLOW>", "<OUTFLOW>"]
# ---------------------------------------------------------------------------


def special_token_list(variant: str = "binned") -> list[str]:
    """The ordered special tokens of a variant (ids = list positions)."""
    months = [f"{MONTH}{m}>" for m in range(1, 13)]
    days = [f"{DAY}{d}>" for d in range(1, 32)]
    weekdays = [f"{WEEKDAY}{w}>" for w in range(7)]
    if variant == "binned":
        amounts = [f"{AMOUNT}{i}>" for i in range(len(AMOUNT_EDGES))]
        return [PAD, UNK] + SIGN_TOKENS + amounts + months + days + weekdays + [SEP]
    if variant == "spaced":
        amounts = [f"{AMOUNT}{r}>" for r in AMOUNT_RANGES_6]
        return [PAD, UNK] + ORIGIN_TOKENS + SIGN_TOKENS + amounts + months + days + weekdays + [SEP]
    if variant == "tagged":
        return list(TAGGED_SPECIALS)
    raise ValueError(f"unknown variant {variant!r}")


def special_tokens(spark: SparkSession, variant: str = "binned") -> DataFrame:
    """U1 as a DataFrame (token, id, is_special): the list, exploded with its places as ids."""
    toks = special_token_list(variant)
    arr = F.array(*[F.lit(t) for t in toks])
    return (spark.range(1).select(F.posexplode(arr).alias("id", "token"))
            .select("token", F.col("id").cast("int").alias("id"), F.lit(True).alias("is_special")))


def word_vocabulary(spark: SparkSession, words: DataFrame, variant: str = "binned",
                    word_col: str = "word") -> DataFrame:
    """Specials first, then each distinct word in code-point order.

    A deterministic, data-derived word-level vocabulary (whole words, no
    sub-word merges); numbering is distributed (``global_index``).
    """
    sp = special_tokens(spark, variant)
    n_sp = len(special_token_list(variant))
    distinct = (words.select(F.col(word_col).alias("token")).where(F.col("token").isNotNull())
                .distinct()
                .join(sp.select("token"), "token", "left_anti"))
    learned = global_index(distinct, [F.col("token").cast("binary")], start=n_sp, name="id")
    learned = learned.select("token", F.col("id").cast("int").alias("id"), F.lit(False).alias("is_special"))
    return sp.unionByName(learned)


def specials_of(vocab: DataFrame, by_prefix: bool = False) -> DataFrame:
    """Special tokens of a loaded vocabulary; ``by_prefix`` mimics the
    reference's load rule (token starts with ``<`` or ``[``)."""
    if by_prefix:
        return vocab.where(F.col("token").startswith("<") | F.col("token").startswith("["))
    return vocab.where(F.col("is_special"))


def _map_array(df: DataFrame, vocab: DataFrame, key_cols: Sequence[str], col: str, out_col: str,
               src: str, dst: str, fill, vocab_rows: int | None) -> DataFrame:
    """Map the elements of ``col`` through ``vocab`` (``src`` -> ``dst``).

    A vocabulary of few rows and bytes (``joins.travels``) travels to the rows;
    ``vocab_rows`` spares counting one that is known to be too large. For it,
    elements are exploded, joined and re-collected per ``key_cols``
    (one output row per key; arrays stay as bounded as the input's)."""
    keys = list(key_cols)
    if travels(vocab, src, dst, vocab_rows):
        return lookup_in_arrays(df.select(*keys, col), bucketed(vocab, src, dst), col, "_out", fill).select(*keys, F.col("_out").alias(out_col))
    long = df.select(*keys, F.posexplode_outer(col).alias("_pos", "_src"))
    v = vocab.select(F.col(src).alias("_src"), F.col(dst).alias("_dst"))
    j = long.join(v, "_src", "left")
    val = F.col("_dst") if fill is None else F.coalesce(F.col("_dst"), F.lit(fill))
    keep = F.col("_pos").isNotNull() & (val.isNotNull() if fill is None else F.lit(True))
    return (j.groupBy(*keys)
            .agg(F.sort_array(F.collect_list(F.when(keep, F.struct(F.col("_pos"), val.alias("_v"))))).alias("_l"))
            .select(*keys, F.transform("_l", lambda s: s["_v"]).alias(out_col)))


def tokens_to_ids(df: DataFrame, vocab: DataFrame, tokens_col: str, key_cols: Sequence[str],
                  out_col: str = "ids", unk_id: int | None = 1, vocab_rows: int | None = None) -> DataFrame:
    """J4 on an array column. Unknown tokens -> ``unk_id``; with
    ``unk_id=None`` they are dropped."""
    return _map_array(df, vocab, key_cols, tokens_col, out_col, "token", "id", unk_id, vocab_rows)


def ids_to_tokens(df: DataFrame, vocab: DataFrame, ids_col: str, key_cols: Sequence[str],
                  out_col: str = "tokens", vocab_rows: int | None = None) -> DataFrame:
    """Ids back to token strings, order kept; unknown ids are dropped."""
    return _map_array(df, vocab, key_cols, ids_col, out_col, "id", "token", None, vocab_rows)


def decode(tokens_col: str) -> "F.Column":
    """Concatenate pieces without separator (spaces are lost, as in the
    reference's decoder with no end-of-word suffix)."""
    return F.array_join(F.col(tokens_col), "")


__all__ = ["special_token_list", "special_tokens", "word_vocabulary", "specials_of", "tokens_to_ids",
           "ids_to_tokens", "decode", "Sequence"]
