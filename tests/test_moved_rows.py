"""What is moved between tasks: tokens once, vectors as sums of their keys."""
from pyspark.sql import functions as F

from ledgerloom.operators import embed as EM
from ledgerloom.operators import models as MO
from ledgerloom.operators import sequence as S
from ledgerloom.operators import vectors as V
from ledgerloom.plans import catalog as C


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _events(spark, users=3000):
    return spark.range(users * 3).select((F.col("id") % users).alias("u"), F.col("id").alias("t"), F.array(F.lit("a"), F.concat(F.lit("t"), F.col("id") % 7)).alias("toks"))


def test_whole_keys_are_cut_where_they_are_sorted(spark, monkeypatch):
    held = []
    monkeypatch.setattr(S, "hold", lambda df: held.append(df.persist()) or held[-1])
    df = S.assemble_sequences(_events(spark), "u", ["t"], "toks", sep="|", chunk_len=4, num_partitions=3)
    assert df.count() == 3000 * 2 and df.where("seq_len = 8").count() == 3000 * 2
    assert held[0].where("chunk is null").count() <= 2 * 3  # the first and last key of each batch


def test_pieces_smaller_than_a_key(spark):
    ev = spark.createDataFrame([(u, i, [f"{u}{i}"] * (i % 3)) for u in "abcd" for i in range(50)] + [("e", 0, []), ("f", 0, []), ("f", 1, [])], "u string, t int, toks array<string>")
    want = {u: [x for i in range(50) for x in [f"{u}{i}"] * (i % 3)] for u in "abcd"} | {"e": [], "f": []}
    for rows in (0, 2, 16):
        got = {}
        for r in S.assemble_sequences(ev, "u", ["t"], "toks", chunk_len=7, num_partitions=3, piece_rows_log2=rows).orderBy("u", "chunk").collect():
            assert r["seq_len"] == len(want[r["u"]]) and r["offset"] == r["chunk"] * 7
            got.setdefault(r["u"], []).extend(r["tokens"])
        assert got == want


def test_only_border_tokens_are_joined(spark):
    seqs = spark.createDataFrame([("x", 0, list("abcd")), ("x", 1, list("ef")), ("y", 0, ["a"])], "u string, chunk int, tokens array<string>")
    got = V.cooccurrences(seqs, "u", 2)
    pairs = {(r["left"] + r["right"]): r["cnt"] for r in got.collect()}
    assert pairs == dict.fromkeys(["ab", "bc", "cd", "de", "ef", "ac", "bd", "ce", "df"], 1)
    joins = [x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Project" in x and "chunk" in x]
    assert joins and all("slice(tokens" in x for x in joins)


def test_vectors_are_summed_where_the_chunks_lie(spark):
    seqs = spark.createDataFrame([("x", 0, ["p", "q"]), ("x", 1, ["p"]), ("y", 0, ["q"]), ("none", 0, ["unknown"])], "u string, chunk int, tokens array<string>")
    vectors = spark.createDataFrame([("p", [1.0, 0.0]), ("q", [0.0, 3.0])], "token string, vector array<double>")
    df = V.pooled(seqs, "u", vectors)
    assert ", token#" not in "".join(x for x in _plan(df).splitlines() if "hashpartitioning" in x)
    assert {(r["u"], r["dim"]): r["value"] for r in df.collect()} == {("x", 0): 2 / 3, ("x", 1): 1.0, ("y", 0): 0.0, ("y", 1): 3.0}


def test_pool_mean_of_uneven_vectors(spark):
    ids = spark.createDataFrame([("x", 1), ("x", 1), ("x", 2), ("y", 3), ("z", 9)], "u string, token_id int")
    table = spark.createDataFrame([(1, [1.0, 2.0]), (2, [4.0, None, 7.0]), (3, []), (9, None)], "vec_id long, embedding array<float>")
    df = EM.pool_mean(ids, table, "u")
    assert "posexplode(embedding" not in _plan(df)  # a vector is one row
    assert {(r["u"], r["dim"]): r["value"] for r in df.collect()} == {("x", 0): 2.0, ("x", 1): 4 / 3, ("x", 2): 7.0}
    assert EM.pool_mean(ids, table.limit(0), "u").collect() == []


def test_fusion_counts_its_bag_once(spark):
    users = spark.createDataFrame([(k, 1.0 * k, k % 2, k % 2, 1 - k % 2) for k in range(6)], "u long, x double, c int, pos int, neg int")
    bag = spark.createDataFrame([(k, f"t{k % 3}", 2) for k in range(6)], "u long, token string, cnt long")
    df = MO.fusion_bayes(users, bag, "u", ["c"], ["x"])
    assert _plan(df).count("InMemoryTableScan") >= 2
    assert df.count() == 6


def test_a_documents_tokens_are_counted_where_its_text_lies(spark):
    plan = _plan(C.docq_scores(spark, "/root/testdata/sf0.001"))
    assert not [x for x in plan.splitlines() if "hashpartitioning(user_id#" in x and "token#" in x]
