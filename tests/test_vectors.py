"""Learned token vectors against a dense factorisation."""
import math
import random
from collections import Counter

import numpy as np

from ledgerloom.operators import vectors as V


def _sequences(spark, seqs, chunk_len):
    rows = [(u, k, s[k * chunk_len:(k + 1) * chunk_len]) for u, s in seqs.items() for k in range(-(-len(s) // chunk_len))]
    return spark.createDataFrame(rows, "u string, chunk int, tokens array<string>")


def _dense(seqs, window):
    c = Counter((s[i], s[i + d]) for s in seqs.values() for d in range(1, window + 1) for i in range(len(s) - d))
    sym = Counter()
    for (a, b), n in c.items():
        sym[a, b] += n
        sym[b, a] += n
    m, total = Counter(), sum(sym.values())
    for (a, _), n in sym.items():
        m[a] += n
    return c, {(a, b): math.log(n * total / (m[a] * m[b])) for (a, b), n in sym.items() if n * total > m[a] * m[b]}


def _made(n_users=60):
    r = random.Random(3)
    topics = [[f"{t}{k}" for k in range(12)] for t in "abcde"]
    return {f"u{u}": [r.choice(topics[(u + (r.random() < 0.1)) % 5]) for _ in range(r.randint(1, 80))] for u in range(n_users)}


def test_cooccurrences_and_ppmi(spark):
    seqs = _made()
    for window, chunk_len in ((1, 5), (2, 7), (4, 4), (3, 1000)):
        counts, ppmi = _dense(seqs, window)
        got = V.cooccurrences(_sequences(spark, seqs, chunk_len), "u", window)
        assert {(x["left"], x["right"]): x["cnt"] for x in got.collect()} == dict(counts)
    values = {(x["a"], x["b"]): x["value"] for x in V.ppmi(got).collect()}
    assert values.keys() == ppmi.keys() and all(abs(values[k] - ppmi[k]) < 1e-12 for k in ppmi)


def test_vectors_span_the_dense_factors(spark):
    seqs = _made()
    _, ppmi = _dense(seqs, 2)
    names = sorted({a for a, _ in ppmi})
    at = {t: i for i, t in enumerate(names)}
    dense = np.zeros((len(names), len(names)))
    for (a, b), v in ppmi.items():
        dense[at[a], at[b]] = v
    value, vec = np.linalg.eigh(dense)
    order = np.argsort(-np.abs(value))
    rank = 5  # five topics: the gap after it is wide
    table = V.ppmi(V.cooccurrences(_sequences(spark, seqs, 16), "u", 2))
    got = {x["token"]: x["vector"] for x in V.token_vectors(table, rank, steps=8).collect()}
    mine = np.array([got[t] for t in names])
    assert sorted(got) == names and mine.shape == (len(names), rank)
    np.testing.assert_allclose(np.sort((mine ** 2).sum(axis=0)), np.sort(np.abs(value[order[:rank]])), rtol=1e-3)
    q, _ = np.linalg.qr(mine)
    cosines = np.linalg.svd(q.T @ vec[:, order[:rank]], compute_uv=False)
    assert cosines.min() > 0.999
    again = {x["token"]: x["vector"] for x in V.token_vectors(table.repartition(3), rank, steps=8).collect()}
    assert all(np.allclose(got[t], again[t], atol=1e-6) for t in names)
    near = lambda a, b: float(np.dot(got[a], got[b]) / np.linalg.norm(got[a]) / np.linalg.norm(got[b]))
    assert np.mean([near("a0", f"a{k}") for k in range(1, 12)]) > np.mean([near("a0", f"c{k}") for k in range(12)]) + 0.3


def test_pooled(spark):
    seqs = {"x": ["p", "q", "p"], "y": ["q"], "none": ["unknown"]}
    vectors = spark.createDataFrame([("p", [1.0, 0.0]), ("q", [0.0, 3.0])], "token string, vector array<double>")
    got = {(r["u"], r["dim"]): r["value"] for r in V.pooled(_sequences(spark, seqs, 2), "u", vectors).collect()}
    assert got == {("x", 0): 2 / 3, ("x", 1): 1.0, ("y", 0): 0.0, ("y", 1): 3.0}


def test_empty(spark):
    seqs = spark.createDataFrame([], "u string, chunk int, tokens array<string>")
    assert V.token_vectors(V.ppmi(V.cooccurrences(seqs, "u"))).collect() == []
