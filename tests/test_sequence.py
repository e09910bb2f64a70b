"""Sequence assembly: equal to a naive per-user build, chunking, separators,
null keys, and independence from the partition count."""
import datetime as dt

from pyspark.sql import functions as F

from ledgerloom.operators import sequence as S


def _events(spark):
    rows = []
    base = dt.datetime(2023, 1, 1)
    for u, n in [(1, 1), (2, 3), (3, 40), (None, 2)]:
        for i in range(n):
            rows.append((u, i, base + dt.timedelta(hours=i), [f"a{u}_{i}", f"b{i}"]))
    rows.append((2, 99, base, ["tie"]))  # equal timestamp to tx 0 of user 2
    return spark.createDataFrame(rows, "user_id long, tx_id long, date timestamp_ntz, toks array<string>")


def _naive(rows, sep=None, prefix=(), suffix=()):
    by = {}
    for r in rows:
        if r.user_id is None:
            continue
        by.setdefault(r.user_id, []).append(r)
    out = {}
    for u, rs in by.items():
        rs.sort(key=lambda r: (r.date, r.tx_id))
        seq = list(prefix)
        for i, r in enumerate(rs):
            seq += list(r.toks)
            if sep is not None and i < len(rs) - 1:
                seq.append(sep)
        seq += list(suffix)
        out[u] = seq
    return out


def _rebuild(df, L):
    got = {}
    for r in df.collect():
        got.setdefault(r.user_id, {})[r.chunk] = r
    whole = {}
    for u, chunks in got.items():
        seq = []
        for k in sorted(chunks):
            c = chunks[k]
            assert c.offset == k * L
            seq += list(c.tokens)
            assert c.seq_len == sum(len(x.tokens) for x in chunks.values())
        whole[u] = seq
    return whole


def test_matches_naive_with_chunks(spark):
    ev = _events(spark)
    rows = ev.collect()
    for L in (4096, 7, 1):
        for parts in (1, 3, 8):
            df = S.assemble_sequences(ev, "user_id", ["date", "tx_id"], "toks", sep="[SEP]", prefix=["<S>"],
                                      suffix=["<E>"], chunk_len=max(L, 1), num_partitions=parts)
            assert _rebuild(df, max(L, 1)) == _naive(rows, "[SEP]", ["<S>"], ["<E>"])


def test_one_transaction_user_has_no_sep(spark):
    ev = _events(spark)
    df = S.assemble_sequences(ev, "user_id", ["date", "tx_id"], "toks", sep="[SEP]")
    r = df.where(F.col("user_id") == 1).first()
    assert list(r.tokens) == ["a1_0", "b0"]
    assert df.where(F.col("user_id").isNull()).count() == 0


def test_head_tail_holdout(spark):
    ev = _events(spark)
    seqs = S.assemble_sequences(ev, "user_id", ["date", "tx_id"], "toks", sep="[SEP]", chunk_len=5)
    full = _naive(ev.collect(), "[SEP]")
    head = {r.user_id: list(r.tokens) for r in S.head_tokens(seqs, "user_id", 12).collect()}
    head5 = {r.user_id: list(r.tokens) for r in S.head_tokens(seqs, "user_id", 5, chunk_len=5).collect()}
    assert head5 == {u: seq[:5] for u, seq in full.items()}
    tail = {r.user_id: list(r.tokens) for r in S.tail_tokens(seqs, "user_id", 12).collect()}
    for u, seq in full.items():
        assert head[u] == seq[:12]
        assert tail[u] == seq[-12:]
    inp, actual = S.holdout(seqs, "user_id", 3)
    act = {r.user_id: list(r.actual) for r in actual.collect()}
    rest = _rebuild(inp.where(F.col("seq_len") > 0), 5)
    for u, seq in full.items():
        assert act[u] == seq[-3:]
        if len(seq) > 3:
            assert rest[u] == seq[:-3]


def test_next_token_pairs(spark):
    df = spark.createDataFrame([([1, 2, 3],), ([7],)], "tokens array<int>")
    got = [(list(r.x), list(r.y)) for r in S.next_token_pairs(df).collect()]
    assert got == [([1, 2], [2, 3]), ([], [])]


def test_null_items_do_not_depend_on_partitions(spark):
    rows = [(1, 1, ["a"]), (1, 2, None), (1, 3, ["b"]), (2, 1, None), (3, 1, []), (None, 1, ["x"])]
    df = spark.createDataFrame(rows, "k long, t int, items array<string>")
    want = None
    for n in (1, 3, 8):
        out = S.assemble_sequences(df, "k", ["t"], "items", sep="|", num_partitions=n)
        got = sorted((r.k, tuple(r.tokens)) for r in out.collect())
        want = want or got
        assert got == want
    assert (1, ("a", "|", "|", "b")) in want
