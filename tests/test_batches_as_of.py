"""As-of sequences, epoch permutations, length-packed batches, one-class and unlabelled rows."""
import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import metrics as M
from ledgerloom.operators import models as MO
from ledgerloom.operators import sequence as S
from ledgerloom.operators import split as SP

T0 = datetime(2024, 1, 1)


@pytest.mark.parametrize("chunk_len,n", [(7, 5), (4096, 40), (3, 20)])
def test_label_sequences_as_of(spark, chunk_len, n):
    r = random.Random(chunk_len)
    users = ["hot"] * 6 + ["a", "b", None]
    events = []
    for k in range(400):
        t = None if r.random() < 0.02 else T0 + timedelta(hours=r.randrange(60))
        toks = None if r.random() < 0.05 else [f"t{r.randrange(50)}" for _ in range(r.randint(0, 4))]
        events.append((r.choice(users), t, k, toks))
    labels = [(k, r.choice([*users, "nobody"]), None if r.random() < 0.05 else T0 + timedelta(hours=r.randrange(-5, 70)), "x") for k in range(200)]
    ev = spark.createDataFrame(events, "user_id string, date timestamp_ntz, tx_id long, toks array<string>").repartition(5)
    lab = spark.createDataFrame(labels, "row_id long, user_id string, as_of timestamp_ntz, chunk string")
    got = {x["row_id"]: x["tokens"] for x in S.label_sequences_as_of(ev, lab, "user_id", ["date", "tx_id"], "toks", "row_id", "as_of", n,
                                                                      sep="|", chunk_len=chunk_len).collect()}
    by_user = defaultdict(list)
    for u, t, k, toks in events:
        if u is not None and t is not None:
            by_user[u].append((t, k, toks or []))
    assert len(got) == len(labels)
    for row, u, at, _ in labels:
        flat = [x for t, _, toks in sorted(by_user.get(u, [])) if at is not None and t <= at for x in [*toks, "|"]][:-1]
        assert got[row] == flat[-n:], (row, u, at)


def test_as_of_without_events_or_labels(spark):
    ev = spark.createDataFrame([], "user_id string, date timestamp_ntz, tx_id long, toks array<string>")
    lab = spark.createDataFrame([(1, "a", T0)], "row_id long, user_id string, as_of timestamp_ntz")
    assert [tuple(x) for x in S.label_sequences_as_of(ev, lab, "user_id", ["date", "tx_id"], "toks", "row_id", "as_of", 3).collect()] == [(1, "a", T0, [])]
    assert S.label_sequences_as_of(ev, lab.limit(0), "user_id", ["date", "tx_id"], "toks", "row_id", "as_of", 3).collect() == []


def test_permutation_is_a_bijection(spark):
    for n in (1, 2, 3, 17, 256, 1000):
        df = spark.range(n).select(F.col("id").alias("position"))
        rows = SP.epoch_batches(df, 16, seed=7, epochs=3).collect()
        orders = [[x["shuffled"] for x in sorted(rows, key=lambda x: x["position"]) if x["epoch"] == e] for e in range(3)]
        assert all(sorted(o) == list(range(n)) for o in orders)
        sizes = Counter((x["epoch"], x["batch_id"]) for x in rows)
        assert all(c == 16 for (_, b), c in sizes.items() if (b + 1) * 16 <= n)
        if n == 1000:
            assert orders[0] != orders[1] != orders[2]
            fixed = [sum(i == v for i, v in enumerate(o)) for o in orders]
            assert max(fixed) < 12  # about one is expected
            moved = [sum(abs(o[i + 1] - o[i]) < 10 for i in range(n - 1)) for o in orders]
            assert max(moved) < 60  # neighbours part (about 19 are expected to stay near)


def test_epochs_do_not_sort(spark):
    plan = SP.epoch_batches(spark.range(1000).select(F.col("id").alias("position")), 16, 7, 2)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "hashpartitioning" not in plan and "Sort" not in plan


def test_packed_batches(spark):
    r = random.Random(4)
    rows = [(k, min(int(r.paretovariate(1.1) * 4), 513)) for k in range(2000)] + [(k, 3) for k in range(2000, 2700)]
    out = SP.packed_batches(spark.createDataFrame(rows, "id long, length int"), "id", n_buckets=8, budget=1024).collect()
    assert sorted((x["id"], x["length"]) for x in out) == sorted(rows)
    batches = defaultdict(list)
    for x in out:
        batches[x["batch_id"]].append(x["length"])
    assert sorted(batches) == list(range(len(batches)))
    assert all(len(v) * max(v) <= 1024 or len(v) == 1 for v in batches.values())
    share = SP.padding_share(spark.createDataFrame(out)).first()
    assert share["tokens"] == sum(n for _, n in rows) and share["padding"] < 0.25
    empty = SP.packed_batches(spark.createDataFrame([], "id long, length int"), "id")
    assert empty.collect() == [] and SP.padding_share(empty).first()["padding"] is None


@pytest.mark.parametrize("label", [0, 1, None])
def test_one_class(spark, label):
    df = spark.createDataFrame([(0.1 * k, label) for k in range(5)], "score double, label int")
    auc = M.roc_auc(df).first()
    assert auc["auc"] is None
    report = M.evaluate_scores(df.withColumnRenamed("score", "logit")).first()
    assert report["auc"] is None and report["n"] == 5


def test_fusion_bayes_of_one_class(spark):
    users = spark.createDataFrame([(k, 1.0 * k, k % 2, 1, 0) for k in range(6)], "u long, x double, c int, pos int, neg int")
    bag = spark.createDataFrame([(k, f"t{k % 3}", 2) for k in range(6)], "u long, token string, cnt long")
    rows = MO.fusion_bayes(users, bag, "u", ["c"], ["x"]).collect()
    assert len(rows) == 6 and all(x["logit"] is not None and x["logit"] > 0 for x in rows)


def test_split_keeps_unlabelled_rows(spark):
    df = spark.createDataFrame([(k, None if k % 5 == 0 else k % 2) for k in range(50)], "row_id long, label int")
    out = SP.stratified_split(df).collect()
    assert len(out) == 50 and sum(x["is_test"] for x in out) == 10
    assert sum(x["is_test"] for x in out if x["label"] is None) == 2
