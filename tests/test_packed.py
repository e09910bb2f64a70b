"""What is held between the passes over sequences is packed, and windows are not moved by id."""
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from ledgerloom.operators import sequence as S
from ledgerloom.operators import vectors as V


def _holding(monkeypatch):
    held = []
    monkeypatch.setattr(S, "hold", lambda df: held.append(df.persist()) or held[-1])
    return held


def _made(seed, users, events, labels, ids=None):
    r = random.Random(seed)
    ev = [(r.choice(users), r.randrange(30), k, [f"token-{r.randrange(40)}" for _ in range(r.randint(0, 4))]) for k in range(events)]
    lab = [(r.randrange(ids) if ids else k, r.choice([*users, "nobody"]), r.randrange(-2, 33)) for k in range(labels)]
    by_user = defaultdict(list)
    for u, t, k, toks in sorted(ev, key=lambda x: x[1:3]):
        by_user[u].append((t, [*toks, "|"]))
    return ev, lab, {(u, at): [x for t, toks in by_user[u] if t <= at for x in toks][:-1] for _, u, at in lab}


EV, LAB = "u string, t int, k long, toks array<string>", "id long, u string, at int"


def test_windows_are_held_packed_and_not_moved(spark, monkeypatch):
    held = _holding(monkeypatch)
    ev, lab, flat = _made(1, ["hot"] * 9 + ["a", "b"], 3000, 2000)
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    try:
        df = S.label_sequences_as_of(spark.createDataFrame(ev, EV), spark.createDataFrame(lab, LAB), "u", ["t", "k"], "toks", "id", "at", 128, sep="|")
        got = {x["id"]: x["tokens"] for x in df.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert got == {i: flat[u, at][-128:] for i, u, at in lab}
    assert len(held) == 1 and held[0].count() <= 3 * 4  # packed rows, open ones, the last key's tokens
    size = held[0].agg(F.sum(F.coalesce(F.length("_z"), F.lit(0)) + F.coalesce(F.length("_pool"), F.lit(0)))).first()[0]
    assert size < sum(len(x) for w in got.values() for x in w) / 20


def test_windows_of_repeated_ids(spark, monkeypatch):
    _holding(monkeypatch)
    ev, lab, flat = _made(2, ["hot"] * 9 + ["a"], 400, 60, ids=40)
    n, cut = 20, 7
    df = S.label_sequences_as_of(spark.createDataFrame(ev, EV), spark.createDataFrame(lab, LAB), "u", ["t", "k"], "toks", "id", "at", n, sep="|", chunk_len=cut)
    parts, count = defaultdict(list), defaultdict(int)
    for i, u, at in lab:
        count[i] += 1
        hi = len(flat[u, at])
        for c in range(max(hi - n, 0) // cut, -(-hi // cut)):
            parts[i].append((c, flat[u, at][max(hi - n, c * cut):min(hi, (c + 1) * cut)]))
    assert max(count.values()) > 1
    want = sorted((i, u, at, [x for _, p in sorted(parts[i]) for x in p] if count[i] > 1 else flat[u, at][-n:]) for i, u, at in lab)
    assert sorted(map(tuple, df.collect())) == want


def test_a_key_over_many_partitions_and_batches(spark, monkeypatch):
    """A key's first label rows of a partition take tokens of the ones before it."""
    _holding(monkeypatch)
    ev, lab, flat = _made(3, ["hot"], 500, 80)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        df = S.label_sequences_as_of(spark.createDataFrame(ev, EV), spark.createDataFrame(lab, LAB), "u", ["t", "k"], "toks", "id", "at", 300, sep="|")
        assert {x["id"]: x["tokens"] for x in df.collect()} == {i: flat[u, at][-300:] for i, u, at in lab}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10000)


def test_pieces_are_held_packed(spark, monkeypatch):
    """Closed chunks and the pieces of a hot key alike: a few compressed bytes a token."""
    held = _holding(monkeypatch)
    ev = [(u, k, [f"a-long-token-{(k * 7 + len(u)) % 11}"] * 3) for u in ["hot"] * 40 + [f"u{i}" for i in range(60)] for k in range(40)]
    df = S.assemble_sequences(spark.createDataFrame(ev, EV.replace("k long, ", "")), "u", ["t"], "toks", sep="|", chunk_len=16, num_partitions=3)
    got = defaultdict(list)
    for r in df.orderBy("u", "chunk").collect():
        assert r["offset"] == r["chunk"] * 16 and (len(r["tokens"]) == 16 or r["offset"] + len(r["tokens"]) == r["seq_len"])
        got[r["u"]] += r["tokens"]
    want = defaultdict(list)
    for u, _, toks in sorted(ev):
        want[u] += [*toks, "|"]
    assert got == {u: x[:-1] for u, x in want.items()}
    assert [f.name for f in held[0].schema if f.dataType.typeName() == "array"] == []
    size = held[0].agg(F.sum(F.length("_z") + F.length("_pool"))).first()[0]
    assert size < sum(len(x) for toks in got.values() for x in toks) / 3


def test_packed_rows_come_back(spark, monkeypatch):
    """In batches of bounded tokens, with nulls among keys' tokens, numbers and empty arrays."""
    _holding(monkeypatch)
    monkeypatch.setattr(S, "UNPACKED", 5)
    for kind, value in (("string", lambda x: None if x % 5 == 0 else str(x)), ("long", lambda x: x)):
        ev = [(u, t, [value(u * t + i) for i in range((u + t) % 4)]) for u in range(30) for t in range(6)]
        df = S.assemble_sequences(spark.createDataFrame(ev, f"u long, t int, toks array<{kind}>"), "u", ["t"], "toks", chunk_len=4, num_partitions=2)
        got = defaultdict(list)
        for r in df.orderBy("u", "chunk").collect():
            got[r["u"]] += r["tokens"]
        assert got == {u: [x for t in range(6) for x in ev[u * 6 + t][2]] for u in range(30)}


def test_distances_are_counted_in_one_pass(spark, monkeypatch):
    """The tokens are read once for the pairs inside chunks and twice for the borders, whatever the window."""
    _holding(monkeypatch)
    ev = spark.createDataFrame([("x", t, [f"t{t % 4}", "y"]) for t in range(30)], EV.replace("k long, ", ""))
    seqs = S.assemble_sequences(ev, "u", ["t"], "toks", chunk_len=8, num_partitions=2)
    reads = seqs._jdf.queryExecution().executedPlan().toString().count("InMemoryTableScan")
    df = V.cooccurrences(seqs, "u", 5)
    assert df._jdf.queryExecution().executedPlan().toString().count("InMemoryTableScan") <= 3 * reads
    flat = [x for t in range(30) for x in (f"t{t % 4}", "y")]
    want = Counter((flat[i], flat[i + d]) for d in range(1, 6) for i in range(len(flat) - d))
    assert {(r["left"], r["right"]): r["cnt"] for r in df.collect()} == dict(want)


def test_token_vectors_over_packed_chunks(spark, monkeypatch):
    """No tokens are held as rows while vectors are learned, and these are the ones of whole sequences."""
    held = _holding(monkeypatch)
    r = random.Random(4)
    ev = [(f"u{u}", t, [r.choice("abcdef" if u % 2 else "uvwxyz") for _ in range(3)]) for u in range(30) for t in range(20)]
    events = spark.createDataFrame(ev, EV.replace("k long, ", ""))
    whole = defaultdict(list)
    for u, _, toks in ev:
        whole[u] += toks
    plain = spark.createDataFrame([(u, 0, x) for u, x in whole.items()], "u string, chunk int, tokens array<string>")
    chunks = S.assemble_sequences(events, "u", ["t"], "toks", chunk_len=8, num_partitions=3)
    got, want = ({x["token"]: x["vector"] for x in V.token_vectors(V.ppmi(V.cooccurrences(s, "u", 2)), rank=2).collect()} for s in (chunks, plain))
    assert got.keys() == want.keys() and len(got) == 12
    assert all(abs(a - b) < 1e-6 for t in got for a, b in zip(got[t], want[t]))
    assert len(held) == 1 and not [f for f in held[0].schema if f.dataType.typeName() == "array"]
