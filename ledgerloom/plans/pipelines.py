"""End-to-end pipelines (the reference's scripts as Spark jobs).

* ``pretrain_data``: transactions -> vocabulary -> per-user id sequences ->
  padded next-token batches (L1 up to the trainer).
* ``finetune_data``: labels + features + sequences -> split -> rows with a
  sequence window, a feature vector and a label (L2 up to the trainer).
* ``predict_next``: held-out tails -> greedy n-gram predictions -> accuracy (L3).
* ``history_strings`` / ``tagged_sequences``: the string pipelines (L4).

Every function only builds DataFrames, except where a model must be
fitted (BPE rounds, Spark ML fit).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import encode as E
from ledgerloom.operators import bpe as B
from ledgerloom.operators import features as FT
from ledgerloom.operators import ngram as NG
from ledgerloom.operators import sequence as S
from ledgerloom.operators import split as SP
from ledgerloom.operators import vocab as V


@dataclass
class PretrainConfig:
    vocab_size: int = 10000
    context_length: int = 512
    batch_size: int = 16
    epochs: int = 3
    seed: int = 42
    chunk_len: int = S.DEFAULT_CHUNK_LEN


def train_description_tokenizer(spark: SparkSession, tx: DataFrame, cfg: PretrainConfig) -> B.BpeModel:
    """L1 tokenizer: BPE over the distinct non-null descriptions."""
    d = tx.select("description").where(F.col("description").isNotNull()).distinct()
    return B.train_bpe(spark, B.word_histogram(d, "description"), cfg.vocab_size,
                       V.special_token_list("binned"))


def encode_transactions(tx: DataFrame, model: B.BpeModel, order_cols=("date", "tx_id")) -> DataFrame:
    """Per-transaction id lists: attribute token ids, then description pieces.

    Each distinct description is encoded once; the transactions get its ids
    through one join on the description (descriptions repeat, so their rows
    are what adaptive execution may split; the encoded side is unique)."""
    ids = model.token_to_id()
    desc = B.encode_texts(tx.select("description").where(F.col("description").isNotNull()).distinct(), ["description"], "description", model)
    attr_map = F.create_map(*[x for t, i in ids.items() if t in set(model.specials) for x in (F.lit(t), F.lit(i))])
    attrs = F.transform(E.attribute_tokens("amount", "date"),
                        lambda t: F.coalesce(F.element_at(attr_map, t), F.lit(ids.get(E.UNK, 1))))
    base = tx.select("user_id", *order_cols, "description", attrs.alias("_attr"))
    j = base.join(desc.select("description", F.col("ids").alias("_ids")), "description", "left")
    return j.select("user_id", *order_cols, F.concat("_attr", F.coalesce("_ids", F.array().cast("array<int>"))).alias("ids"))


def finetune_batches(rows: DataFrame, id_col: str = "row_id", batch_size: int = 32, seed: int = 42, epoch: int = 0,
                     tokens: str = "tokens", pad=E.PAD) -> DataFrame:
    """W6 for fine-tuning: seeded batches of label rows; each row's sequence is
    padded to the longest of its batch, its vector, label and other columns
    stay. Only the ids are numbered; the wide rows move once, to join them."""
    b = SP.assign_batches(rows.select(id_col), id_col, batch_size, seed, epoch)
    j = rows.join(b, id_col)
    etype = rows.schema[tokens].dataType.elementType
    m = F.max(F.size(tokens)).over(Window.partitionBy("batch_id"))
    out = j.withColumn("batch_len", m)
    return out.withColumn(tokens, F.concat(F.col(tokens), F.array_repeat(F.lit(pad).cast(etype), (F.col("batch_len") - F.size(tokens)).cast("int"))))


def id_sequences(tx: DataFrame, model: B.BpeModel, cfg: PretrainConfig) -> DataFrame:
    """Each user's ids over all its transactions, [SEP] between them, in chunks."""
    return S.assemble_sequences(encode_transactions(tx, model), "user_id", ["date", "tx_id"], "ids", sep=model.token_to_id()[E.SEP], chunk_len=cfg.chunk_len)


def pretrain_data(spark: SparkSession, tx: DataFrame, cfg: PretrainConfig) -> tuple[B.BpeModel, DataFrame, DataFrame]:
    """L1: (tokenizer, id sequences, padded batches for epoch 0)."""
    model = train_description_tokenizer(spark, tx, cfg)
    seqs = id_sequences(tx, model, cfg)
    return model, seqs, pretrain_batches(seqs, cfg)


def pretrain_batches(seqs: DataFrame, cfg: PretrainConfig, epoch: int = 0) -> DataFrame:
    """Padded next-token batches of one epoch. The slim user ids are
    numbered first; x and y are derived after the join with the windows."""
    window = S.head_tokens(seqs, "user_id", cfg.context_length + 1, cfg.chunk_len)
    numbered = SP.assign_batches(window.select("user_id"), "user_id", cfg.batch_size, cfg.seed, epoch)
    return SP.pad_batches(S.next_token_pairs(window.join(numbered, "user_id")))


def finetune_data(labels: DataFrame, features: DataFrame, seqs: DataFrame, context_length: int = 512,
                  pad=E.PAD) -> DataFrame:
    """L2: every label row with its first tabular row, its sequence window
    (first ``context_length`` tokens, ``[PAD]`` when empty) and a stratified
    split flag."""
    table = FT.labels_with_features(labels, features)
    firsts = FT.label_first_features(labels, table)
    win = S.head_tokens(seqs, "user_id", context_length)
    rows = FT.label_sequences(firsts, win, pad=pad)
    return SP.stratified_split(rows)


def predict_next(seqs: DataFrame, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """L3: greedy next-k predictions for sequences longer than k + 10, and the
    per-position accuracy against the held-out tokens, which the counts have
    not seen."""
    model = NG.ngram_model(NG.positions_with_context(NG.training_part(seqs, "user_id", k, k + 10), "user_id"))
    ctx, actual = NG.holdout_contexts(seqs.where(F.col("seq_len") > k + 10), "user_id", k)
    pred = NG.greedy_next_tokens(ctx, "user_id", NG.argmax_tables(model), k)
    return pred, NG.next_token_accuracy(pred, actual, "user_id")


def history_strings(tx: DataFrame, chunk_len: int = S.DEFAULT_CHUNK_LEN) -> DataFrame:
    """L4 (spaced form): a user's history, one row per chunk of ``chunk_len``
    transactions (their strings are joined by a space, also across chunks)."""
    ev = tx.select("user_id", "date", "tx_id", F.array(E.spaced_transaction_string(
        "origin", "amount", "date", "description")).alias("items"))
    seqs = S.assemble_sequences(ev, "user_id", ["date", "tx_id"], "items", chunk_len=chunk_len)
    return seqs.select("user_id", "chunk", "offset", "seq_len", F.array_join("tokens", " ").alias("transaction_history"))


def tagged_sequences(split_tx: DataFrame, chunk_len: int = S.DEFAULT_CHUNK_LEN) -> DataFrame:
    """L4 (tagged form): ``<SOS>tx<EOT>tx...<EOS>`` per client, one row per
    chunk of ``chunk_len`` transactions and tags."""
    ev = split_tx.select("client_id", "date", "tx_id", F.array(E.tagged_transaction_string(
        "type", "amount", "hour", "day", "month", "day_week", "merchant")).alias("items"))
    seqs = S.assemble_sequences(ev, "client_id", ["date", "tx_id"], "items", sep="<EOT>",
                                prefix=["<SOS>"], suffix=["<EOS>"], chunk_len=chunk_len)
    return seqs.select("client_id", "chunk", "offset", "seq_len", F.array_join("tokens", "").alias("sequence"))
