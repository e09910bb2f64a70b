"""The n-gram model and greedy prediction against a brute-force build."""
import math
from collections import Counter

from pyspark.sql import functions as F

from ledgerloom.operators import ngram as NG
from ledgerloom.operators import sequence as S

SEQS = {1: list("abcabcabd"), 2: list("abcd"), 3: list("xyab"), 4: list("bcabcabcabcabcab")}


def _seqs(spark, chunk_len):
    rows = [(u, i, [t]) for u, s in SEQS.items() for i, t in enumerate(s)]
    ev = spark.createDataFrame(rows, "user_id long, i long, toks array<string>")
    return S.assemble_sequences(ev, "user_id", ["i"], "toks", chunk_len=chunk_len)


def _brute():
    uni, bi, tri = Counter(), Counter(), Counter()
    for s in SEQS.values():
        for i, w in enumerate(s):
            uni[w] += 1
            if i >= 1:
                bi[(s[i - 1], w)] += 1
            if i >= 2:
                tri[(s[i - 2], s[i - 1], w)] += 1
    N, V = sum(uni.values()), len(uni)
    p0 = {w: (c + 1 / V) / (N + 1) for w, c in uni.items()}
    c1 = Counter()
    for (u, _w), c in bi.items():
        c1[u] += c
    p1 = {(u, w): (c + p0[w]) / (c1[u] + 1) for (u, w), c in bi.items()}
    c2 = Counter()
    for (t, u, _w), c in tri.items():
        c2[(t, u)] += c
    p2 = {(t, u, w): (c + p1[(u, w)]) / (c2[(t, u)] + 1) for (t, u, w), c in tri.items()}
    return p0, p1, p2


def test_probabilities_match_brute_force(spark):
    p0, p1, p2 = _brute()
    for L in (3, 4096):  # tiny chunks: contexts must cross chunk borders
        m = NG.ngram_model(NG.positions_with_context(_seqs(spark, L), "user_id"))
        got2 = {(r.c2, r.c1, r.token): r.p2 for r in m["p2"].collect()}
        got1 = {(r.c1, r.token): r.p1 for r in m["p1"].collect()}
        assert got2.keys() == p2.keys() and got1.keys() == p1.keys()
        assert all(math.isclose(got2[k], v, rel_tol=1e-12) for k, v in p2.items())
        assert all(math.isclose(got1[k], v, rel_tol=1e-12) for k, v in p1.items())


def test_greedy_prediction_brute_force(spark):
    p0, p1, p2 = _brute()

    def best(cands):
        return min(cands, key=lambda kv: (-kv[1], kv[0]))[0]

    def predict(t, u, k):
        out = []
        for _ in range(k):
            c2 = [(w, p) for (a, b, w), p in p2.items() if (a, b) == (t, u)]
            c1 = [(w, p) for (b, w), p in p1.items() if b == u]
            nxt = best(c2) if c2 else best(c1) if c1 else best(list(p0.items()))
            out.append(nxt)
            t, u = u, nxt
        return out

    seqs = _seqs(spark, 4)
    m = NG.ngram_model(NG.positions_with_context(seqs, "user_id"))
    ctx, actual = NG.holdout_contexts(seqs, "user_id", 2)
    pred = {r.user_id: list(r.predicted) for r in
            NG.greedy_next_tokens(ctx, "user_id", NG.argmax_tables(m), 3).collect()}
    for u, s in SEQS.items():
        inp = s[:-2]
        assert pred[u] == predict(inp[-2] if len(inp) > 1 else None, inp[-1], 3)
    acc = NG.next_token_accuracy(NG.greedy_next_tokens(ctx, "user_id", NG.argmax_tables(m), 2), actual, "user_id")
    assert acc.count() == 2 and acc.agg(F.max("n")).first()[0] == len(SEQS)


def test_saved_model_predicts_alike(spark, scratch):
    seqs = spark.createDataFrame([(k, 0, 0, 20, [f"t{(k * i) % 5}" for i in range(20)]) for k in range(1, 8)],
                                 "user_id long, chunk int, offset long, seq_len long, tokens array<string>")
    m = NG.ngram_model(NG.positions_with_context(NG.training_part(seqs, "user_id", 3, 13), "user_id"))
    NG.save_model(m, f"{scratch}/ngram")
    again = NG.load_model(spark, f"{scratch}/ngram")
    ctx, _ = NG.holdout_contexts(seqs, "user_id", 3)
    a, b = (sorted((r.user_id, tuple(r.predicted)) for r in NG.greedy_next_tokens(ctx, "user_id", NG.argmax_tables(x), 3).collect()) for x in (m, again))
    assert a == b and len(a) == 7


def test_training_part_leaves_the_tails_out(spark):
    seqs = spark.createDataFrame([(1, 0, 0, 16, [str(i) for i in range(16)]), (2, 0, 0, 4, list("abcd"))],
                                 "user_id long, chunk int, offset long, seq_len long, tokens array<string>")
    got = {r.user_id: list(r.tokens) for r in NG.training_part(seqs, "user_id", 5, 15).collect()}
    assert got == {1: [str(i) for i in range(11)], 2: list("abcd")}
