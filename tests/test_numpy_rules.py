"""Rounding as numpy does it, and columns picked by name."""
import numpy as np

from ledgerloom.operators import features as FT
from ledgerloom.sources import io as IO


def test_amounts_round_as_numpy(spark):
    r = np.random.default_rng(1)
    values = np.concatenate([r.integers(-100_000, 100_000, 3000) / 200, r.integers(-10_000, 10_000, 3000) / 1000, r.normal(0, 1e4, 500), [0.0, -0.005, 0.125, 2.675, 1.005]])
    rows = [(k, "u", float(v), "2024-01-01", " x ") for k, v in enumerate(values)] + [(-1, "u", None, None, None), (-2, None, 1.0, None, None)]
    tx = spark.createDataFrame(rows, "tx_id long, user_id string, amount double, date string, description string")
    got = {x["tx_id"]: x["amount"] for x in IO.normalise_transactions(tx).collect()}
    assert got.pop(-1) is None and -2 not in got
    assert [got[k] for k in range(len(values))] == np.round(values, 2).tolist()


def test_columns_like(spark):
    df = spark.createDataFrame([(1, 2, 3)], "numerical_feat_0 int, user_id int, categorical_feat_1 int")
    assert FT.columns_like(df, "numerical") == ["numerical_feat_0"]
    assert FT.columns_like(df, "feat") == ["numerical_feat_0", "categorical_feat_1"]
    assert FT.columns_like(df, "absent") == []
