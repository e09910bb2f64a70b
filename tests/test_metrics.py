"""Exact metrics against numpy formulas."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import metrics as M


def _auc_numpy(s, y):
    s, y = np.asarray(s, float), np.asarray(y, int)
    order = np.argsort(s, kind="mergesort")
    ranks = np.empty(len(s))
    ss = s[order]
    i = 0
    while i < len(s):
        j = i
        while j + 1 < len(s) and ss[j + 1] == ss[i]:
            j += 1
        ranks[order[i:j + 1]] = (i + j) / 2 + 1
        i = j + 1
    n1, n0 = y.sum(), len(y) - y.sum()
    return (ranks[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)


def _auc(spark, s, y, parts=4):
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)], "score double, label int")
    return M.roc_auc(df, num_partitions=parts).first().auc


def test_auc_edges(spark):
    assert _auc(spark, [0.5] * 6, [0, 1, 0, 1, 1, 0]) == 0.5
    assert _auc(spark, [1, 2, 3, 4], [0, 0, 1, 1]) == 1.0
    assert _auc(spark, [1, 2, 3, 4], [1, 1, 0, 0]) == 0.0


def test_auc_random_ties(spark):
    rng = np.random.default_rng(7)
    s = rng.integers(0, 30, 2000).astype(float)
    y = (rng.random(2000) < 0.3).astype(int)
    for parts in (1, 5, 13):
        assert abs(_auc(spark, s, y, parts) - _auc_numpy(s, y)) < 1e-12


def test_bce_and_sigmoid(spark):
    x = np.array([-3.0, -0.5, 0.0, 2.0, 40.0])
    y = np.array([0, 1, 1, 0, 1])
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y)], "logit double, label int")
    bce = M.bce_with_logits(df).first().bce
    p = 1 / (1 + np.exp(-x))
    want = np.mean(np.logaddexp(0.0, x) - x * y)
    assert abs(bce - np.mean(np.maximum(x, 0) - x * y + np.log1p(np.exp(-np.abs(x))))) < 1e-12
    assert abs(bce - want) < 1e-9
    sig = [r[0] for r in df.select(M.sigmoid("logit")).collect()]
    assert np.allclose(sig, p)


def test_class_cross_entropy(spark):
    df = spark.createDataFrame([([1.0, 3.0], 1), ([2.0, -1.0], 1), ([0.0, 0.0], 0)], "z array<double>, label int")
    got = [r[0] for r in df.select(M.class_cross_entropy_terms("z", "label")).collect()]
    want = [np.log(np.exp(1) + np.exp(3)) - 3, np.log(np.exp(2) + np.exp(-1)) + 1, np.log(2)]
    assert np.allclose(got, want)


def test_mean_of_batch_means(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 3.0), (1, 10.0)], "batch_id long, v double")
    r = M.mean_of_batch_means(df, "v").first()
    assert r.mean_of_batch_means == 6.0 and r.n_batches == 2


def test_cross_entropy_ignores(spark):
    df = spark.createDataFrame([(0.5, 3), (0.25, -1), (0.125, 4)], "p double, y int")
    r = M.cross_entropy(df).first()
    assert r.n_tokens == 2 and abs(r.cross_entropy - (np.log(2) + np.log(8)) / 2) < 1e-12




def test_coerced_text(spark):
    from ledgerloom.operators import features as FT
    cases = {"1": 1, " 2.7 ": 2, "1e30": 0, "1d": 0, "2.5f": 0, "0x1p3": 0, "-3.9": -3, "nan": 0, "inf": 0, "": 0, None: 0, ".5": 0, "1e3": 1000}
    df = spark.createDataFrame([(c,) for c in cases], "c string")
    assert {r.c: r.v for r in df.select("c", FT.coerce_numeric("c", "categorical").alias("v")).collect()} == cases
    x = df.select("c", FT.coerce_numeric("c").alias("v")).collect()
    assert {r.c: round(r.v, 3) for r in x if r.c in ("1d", "2.5f", ".5", "1e30")} == {"1d": 0.0, "2.5f": 0.0, ".5": 0.5, "1e30": pytest.approx(1e30, rel=1e-6)}
