"""Windows before the assembly, one-pass catalogs, split CSV files, bucketed tables."""
import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import features as FT
from ledgerloom.operators import sequence as S
from ledgerloom.sources import io as IO


@pytest.mark.parametrize("sep", [None, "|"])
@pytest.mark.parametrize("n", [1, 6, 50])
def test_edge_tokens_equal_assembled(spark, sep, n):
    r = random.Random(n)
    rows = [(r.choice(["hot"] * 8 + ["a", "b", "c", None]), r.randrange(40), k, None if r.random() < 0.1 else [f"t{k}_{i}" for i in range(r.randint(0, 4))]) for k in range(500)]
    rows += [("none", 1, 900, None), ("none", 2, 901, [])]
    ev = spark.createDataFrame(rows, "u string, t int, k long, toks array<string>").repartition(6)
    seqs = S.assemble_sequences(ev, "u", ["t", "k"], "toks", sep=sep, chunk_len=11)
    for newest, whole in ((True, S.tail_tokens(seqs, "u", n)), (False, S.head_tokens(seqs, "u", n))):
        want = {x["u"]: (x["seq_len"], x["tokens"]) for x in whole.collect()}
        got = {x["u"]: (x["seq_len"], x["tokens"]) for x in S.edge_tokens(ev, "u", ["t", "k"], "toks", n, newest=newest, sep=sep).collect()}
        if sep is None:
            want.pop("none", None)  # a key without any token has no window
            got.pop("none", None)
        assert got == want


def test_edge_tokens_limit_before_the_shuffle(spark):
    ev = spark.range(100).select((F.col("id") % 3).alias("u"), F.col("id").alias("t"), F.array(F.lit("x")).alias("toks"))
    plan = S.edge_tokens(ev, "u", ["t"], "toks", 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Partial") >= 2 and "WindowGroupLimit" in plan


def test_sketched_catalog(spark):
    rows = spark.range(200_000).select((F.col("id") % 7).cast("int").alias("a"), F.when(F.col("id") % 3 == 0, F.col("id") % 1000).alias("b"),
                                       (F.col("id") % 60_000).alias("wide"), (F.col("id") % 5 - 2).alias("negative"), F.lit(None).cast("int").alias("nothing"))
    cols = ["a", "b", "wide", "negative", "nothing"]
    cat = FT.feature_catalog_sketched(rows, ["n"], cols)
    row = cat.first()
    card, exact = row["cat_cardinalities"], row["is_exact"]
    assert (card["a"], card["b"], card["nothing"]) == (7, 1000, 0) and exact["a"] and exact["b"] and exact["nothing"]
    assert not exact["wide"] and not exact["negative"]
    assert abs(card["wide"] - 60_000) < 60_000 * 0.03 and card["negative"] == 5
    assert row["cat_max_plus_one"]["a"] == 7 and row["cat_max_plus_one"]["nothing"] is None
    assert "Expand" not in cat._jdf.queryExecution().executedPlan().toString()
    exactly = FT.feature_catalog(rows, ["n"], ["a", "b"]).first()
    assert exactly["cat_cardinalities"] == {"a": 7, "b": 1000}
    assert FT.feature_catalog_sketched(rows.limit(0), [], ["a"]).first()["cat_cardinalities"] == {"a": 0}


@pytest.mark.parametrize("split", [37, 200, 1 << 20])
def test_split_csv_files(spark, scratch, split):
    r = random.Random(split)
    pieces = ['"', ",", "\n", "\r\n", "a", "bé", " ", "x" * 30, '""', "\n\n"]
    rows = [(f"u{k}", "".join(r.choice(pieces) for _ in range(r.randint(1, 12)))) for k in range(120)]
    rows += [("long", 'q"' + "line\n" * 200 + '"'), ("null", None), ("plain", "no breaks")]
    for f in range(2):
        out = io.StringIO()
        w = csv.writer(out, lineterminator="\n")
        w.writerow(["user_id", "transaction_history"])
        w.writerows([(u, h) for u, h in rows[f::2]])
        with open(f"{scratch}/part{f}.csv", "w", newline="") as fh:
            fh.write(out.getvalue())
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        df = IO.read_csv_split(spark, scratch, IO.HISTORY_SCHEMA)
        got = [tuple(x) for x in df.collect()]
        if split == 200:
            assert spark.read.text(scratch).rdd.getNumPartitions() > 8
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(got, key=repr) == sorted(rows, key=repr)


def test_split_csv_empty(spark, scratch):
    with open(f"{scratch}/x.csv", "w") as fh:
        fh.write("user_id,transaction_history\n")
    assert IO.read_csv_split(spark, scratch, IO.HISTORY_SCHEMA).collect() == []


def test_bucketed_join_moves_one_side(spark, scratch):
    seqs = spark.range(300).select(F.col("id").alias("u"), F.array(F.col("id").cast("string")).alias("tokens"))
    IO.write_bucketed(seqs, "test_bucketed_sequences", f"{scratch}/t", "u", 16)
    try:
        rows = spark.range(1000).select(F.col("id").alias("row"), (F.col("id") % 400).alias("u"))
        j = IO.join_bucketed(rows, spark, "test_bucketed_sequences", "u")
        plan = j._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "SortMergeJoin" in plan
        got = {x["row"]: x["tokens"] for x in j.collect()}
        assert got == {k: [str(k % 400)] if k % 400 < 300 else None for k in range(1000)}
    finally:
        spark.sql("drop table test_bucketed_sequences")
