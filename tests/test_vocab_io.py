"""Vocabularies, id round trips and the readers/writers."""
import dataclasses
import datetime as dt
import os

import numpy as np
from pyspark.sql import functions as F

from ledgerloom.operators import joins as J
from ledgerloom.operators import vocab as V
from ledgerloom.sources import io


def test_special_catalog_sizes(spark):
    assert len(V.special_token_list("binned")) == 76
    assert len(V.special_token_list("spaced")) == 63
    assert V.special_token_list("tagged") == ["<PAD>", "<SOS>", "<EOS>", "<EOT>", "<UNK>"]
    sp = V.special_tokens(spark).orderBy("id").collect()
    assert sp[0].token == "[PAD]" and sp[1].token == "[UNK]" and sp[-1].token == "[SEP]" and sp[-1].id == 75


def test_word_vocab_and_round_trip(spark):
    words = spark.createDataFrame([("b",), ("a",), ("é",), ("a",), ("[SEP]",)], "word string")
    v = V.word_vocabulary(spark, words)
    got = {r.token: r.id for r in v.where(~F.col("is_special")).collect()}
    assert got == {"a": 76, "b": 77, "é": 78}
    df = spark.createDataFrame([(1, ["a", "zz", "[SEP]", "é"]), (2, [])], "k long, t array<string>")
    ids = V.tokens_to_ids(df, v, "t", ["k"])
    assert {r.k: list(r.ids) for r in ids.collect()} == {1: [76, 1, 75, 78], 2: []}
    back = V.ids_to_tokens(ids, v, "ids", ["k"])
    assert {r.k: list(r.tokens) for r in back.collect()} == {1: ["a", "[UNK]", "[SEP]", "é"], 2: []}
    assert V.specials_of(v).count() == 76
    assert V.specials_of(v, by_prefix=True).count() == 76


def test_lookup_beyond_the_bound(spark, monkeypatch):
    """A vocabulary above the bound of rows or of bytes is joined: same ids."""
    v = V.word_vocabulary(spark, spark.createDataFrame([("a",), ("b" * 5000,)], "word string"))
    df = spark.createDataFrame([(1, ["a", "zz", "[SEP]", "b" * 5000]), (2, []), (3, None)], "k long, t array<string>")
    want = {1: [76, 1, 75, 77], 2: [], 3: []}

    def ids(travels):
        out = V.tokens_to_ids(df, v, "t", ["k"])
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert ("_buckets" in plan) == travels
        return {r.k: r.ids and list(r.ids) for r in out.collect()}
    assert {k: i or [] for k, i in ids(True).items()} == want
    with monkeypatch.context() as m:
        m.setattr(J, "MOST_BYTES", 4000)
        assert ids(False) == want
    with monkeypatch.context() as m:
        m.setattr(J, "MOST_ENTRIES", 10)
        assert ids(False) == want
    assert not J.travels(v, "token", "id", J.MOST_ENTRIES + 1) and J.travels(v.limit(0), "token", "id")


def test_lookups_move_no_tokens(spark):
    v = V.special_tokens(spark)
    df = spark.range(100).select("id", F.array(F.lit("[SEP]"), F.lit("x")).alias("t"))
    plan = V.tokens_to_ids(df, v, "t", ["id"])._jdf.queryExecution().executedPlan().toString()
    left = plan.split("BroadcastExchange")[0]
    assert "Generate" not in left and "hashpartitioning(id" not in left


def test_finetune_table(spark, scratch):
    from pyspark.sql import types as T
    df = spark.createDataFrame([("u1", 1, 2.5, 3), ("u2", 0, None, 1)], "user_id string, label int, num_a double, cat_b int")
    io.write_table(df, os.path.join(scratch, "ft"), fmt="csv")
    cat = spark.createDataFrame([(["num_a"], ["cat_b"], {"cat_b": 2})], io.FEATURE_CATALOG_SCHEMA)
    back = io.read_finetune_table(spark, os.path.join(scratch, "ft"), df.schema, cat)
    assert sorted(map(tuple, back.collect())) == [("u1", 1, 2.5, 3), ("u2", 0, None, 1)]
    import pytest
    with pytest.raises(ValueError):
        io.read_finetune_table(spark, os.path.join(scratch, "ft"), T.StructType(df.schema.fields[:2]), cat)


def test_normalised_amounts_and_unread_dates(spark):
    raw = spark.createDataFrame([("u", "2023-01-02 03:04:05", 1.005, " a "), ("v", "02/01/2023", -2.345, "b"), ("w", "", 0.125, None), (None, "x", 1.0, "c")],
                                "user_id string, date string, amount double, description string")
    parsed = raw.withColumn("date", io.parse_timestamp(F.col("date")))
    assert io.unread_dates(raw, parsed, "user_id").first().n_unread == 1
    got = {r.user_id: (r.amount, r.description) for r in io.normalise_transactions(parsed).collect()}
    u, v, w = np.round(np.array([1.005, -2.345, 0.125]), 2).tolist()
    assert got == {"u": (u, "a"), "v": (v, "b"), "w": (w, None)}


def test_csv_transactions_round_trip(spark, scratch):
    rows = [("u1", dt.datetime(2023, 1, 2, 3, 4, 5), -12.5, "Netflix.com"), ("u2", None, None, "NA")]
    df = spark.createDataFrame(rows, io.TRANSACTION_SCHEMA)
    p = os.path.join(scratch, "tx_csv")
    io.write_table(df, p, fmt="csv")
    back = io.read_transactions(spark, p, fmt="csv").orderBy("user_id").collect()
    assert back[0].date == dt.datetime(2023, 1, 2, 3, 4, 5) and back[0].amount == -12.5
    assert back[1].description is None  # pandas-style null text


def test_histories_multiline(spark, scratch):
    df = spark.createDataFrame([("u1", 'a "quoted"\nline [SEP]')], io.HISTORY_SCHEMA)
    p = os.path.join(scratch, "hist")
    io.write_table(df.coalesce(1), p, fmt="csv")
    assert io.read_histories(spark, p).first().transaction_history == 'a "quoted"\nline [SEP]'


def test_sequences_vocab_catalog_config(spark, scratch):
    seqs = spark.createDataFrame([(1, 0, 0, 3, [5, 6, 7])], "user_id long, chunk int, offset long, seq_len long, tokens array<int>")
    io.write_sequences(seqs, os.path.join(scratch, "seqs"))
    assert io.read_sequences(spark, os.path.join(scratch, "seqs")).first().tokens == [5, 6, 7]
    v = V.special_tokens(spark, "tagged")
    io.write_vocabulary(v, None, os.path.join(scratch, "tok"))
    v2, m2 = io.read_vocabulary(spark, os.path.join(scratch, "tok"))
    assert v2.count() == 5 and m2 is None
    cat = spark.createDataFrame([(["n1"], ["c1"], {"c1": 3})], io.FEATURE_CATALOG_SCHEMA)
    io.write_feature_catalog(cat, os.path.join(scratch, "cat"))
    assert io.read_feature_catalog(spark, os.path.join(scratch, "cat")).first().cat_cardinalities == {"c1": 3}

    @dataclasses.dataclass
    class Cfg:
        context_length: int = 512
        batch_size: int = 16

    io.save_config(spark, Cfg(256, 8), os.path.join(scratch, "cfg"))
    assert io.load_config(spark, Cfg, os.path.join(scratch, "cfg")) == Cfg(256, 8)
