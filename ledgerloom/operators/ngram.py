"""Next-token statistics over sequence tables.

The reference learns next-token probabilities with a causal transformer.
Here the same question -- how likely is token w after this context -- is
answered with count tables that Spark builds with joins and map-side
combined aggregates: an interpolated n-gram model of orders 0..2,

    p0(w)       = (c(w) + a/V) / (N + a)
    p1(w | u)   = (c(u, w) + a * p0(w)) / (c(u, .) + a)
    p2(w | t,u) = (c(t, u, w) + a * p1(w | u)) / (c(t, u, .) + a)

with a = 1 and V the number of distinct tokens. Contexts cross chunk
boundaries: each chunk borrows the last two tokens of the previous chunk
through an equi-join on (key, chunk - 1), so no user is ever regrouped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import sequence as S
from ledgerloom.session import hold

ALPHA = 1.0


def positions_with_context(seqs: DataFrame, key: str, order: int = 2) -> DataFrame:
    """(key, pos, c2, c1, token): every position with up to two previous tokens.

    Each chunk is prefixed with exactly two context slots (the previous
    chunk's last tokens, or nulls at the start of a sequence); the contexts
    are then two shifted slices of that array, zipped with the tokens and
    exploded once: linear in the chunk length, all native expressions."""
    if order != 2:
        raise ValueError("contexts of order 2 are supported")
    prev = seqs.select(key, (F.col("chunk") + 1).alias("chunk"),
                       F.slice("tokens", F.greatest(F.size("tokens") - order + 1, F.lit(1)), order).alias("_prev"))
    j = seqs.where(F.size("tokens") > 0).join(prev, [key, "chunk"], "left")
    etype = seqs.schema["tokens"].dataType.elementType.simpleString()
    before = F.coalesce(F.col("_prev"), F.array().cast(f"array<{etype}>"))
    pad = F.array_repeat(F.lit(None).cast(etype), (F.lit(order) - F.size(before)).cast("int"))
    ext = F.concat(pad, before, F.col("tokens"))
    n = F.size("tokens")
    zipped = F.arrays_zip(F.slice(ext, 1, n).alias("c2"), F.slice(ext, 2, n).alias("c1"),
                          F.col("tokens").alias("token"))
    ex = j.select(key, "offset", F.posexplode(zipped).alias("_i", "_r"))
    return ex.select(key, (F.col("offset") + F.col("_i")).alias("pos"), "_r.c2", "_r.c1", "_r.token")


def ngram_counts(positions: DataFrame) -> dict[str, DataFrame]:
    """M1 counts: order 0 (token), 1 (c1, token), 2 (c2, c1, token).

    One map-side combined aggregate over the positions (c2 and c1 may be
    null at a sequence start); the lower orders are sums over that much
    smaller table, so the big input is read once."""
    # read by three branches (and again by the model's joins): keep it once
    full = hold(positions.groupBy("c2", "c1", "token").agg(F.count(F.lit(1)).alias("cnt")))
    tri = full.where(F.col("c2").isNotNull())
    bi = full.where(F.col("c1").isNotNull()).groupBy("c1", "token").agg(F.sum("cnt").alias("cnt"))
    uni = full.groupBy("token").agg(F.sum("cnt").alias("cnt"))
    return {"uni": uni, "bi": bi, "tri": tri, "full": full}


def ngram_model(positions: DataFrame, alpha: float = ALPHA) -> dict[str, DataFrame]:
    """M1 probabilities of every observed n-gram, with the backed-off
    probabilities they interpolate with. Context totals are aggregates; the
    corpus totals (N, V) are one row, broadcast."""
    c = ngram_counts(positions)
    tot = c["uni"].agg(F.sum("cnt").alias("N"), F.count(F.lit(1)).alias("V"))
    p0 = (c["uni"].crossJoin(F.broadcast(tot))  # one row
          .select("token", "cnt", ((F.col("cnt") + F.lit(alpha) / F.col("V")) / (F.col("N") + F.lit(alpha))).alias("p0")))
    ctx1 = c["bi"].groupBy("c1").agg(F.sum("cnt").alias("ctx_cnt"))
    p1 = (c["bi"].join(ctx1, "c1").join(p0.select("token", "p0"), "token")
          .select("c1", "token", "cnt", "p0",
                  ((F.col("cnt") + F.lit(alpha) * F.col("p0")) / (F.col("ctx_cnt") + F.lit(alpha))).alias("p1")))
    ctx2 = c["tri"].groupBy("c2", "c1").agg(F.sum("cnt").alias("ctx_cnt"))
    p2 = (c["tri"].join(ctx2, ["c2", "c1"]).join(p1.select("c1", "token", "p1"), ["c1", "token"])
          .select("c2", "c1", "token", "cnt", "p1",
                  ((F.col("cnt") + F.lit(alpha) * F.col("p1")) / (F.col("ctx_cnt") + F.lit(alpha))).alias("p2")))
    return {"p0": p0, "p1": p1, "p2": p2, "ctx1": ctx1, "ctx2": ctx2, "totals": tot, "full": c["full"]}


def save_model(model: dict[str, DataFrame], path: str) -> None:
    """The probability and argmax tables as Parquet, for prediction elsewhere."""
    for name in ("p0", "p1", "p2"):
        model[name].write.mode("overwrite").parquet(f"{path}/{name}")


def load_model(spark, path: str) -> dict[str, DataFrame]:
    """What ``save_model`` wrote: enough for ``argmax_tables`` and ``position_probabilities``."""
    return {name: spark.read.parquet(f"{path}/{name}") for name in ("p0", "p1", "p2")}


def position_probabilities(positions: DataFrame, model: dict[str, DataFrame]) -> DataFrame:
    """Probability the model gives each position's actual token, using the
    highest order its context allows (training data: always observed)."""
    j = (positions.join(model["p2"].select("c2", "c1", "token", "p2"), ["c2", "c1", "token"], "left")
         .join(model["p1"].select("c1", "token", "p1"), ["c1", "token"], "left")
         .join(model["p0"].select("token", "p0"), "token", "left"))
    p = F.when(F.col("c2").isNotNull(), F.col("p2")).when(F.col("c1").isNotNull(), F.col("p1")).otherwise(F.col("p0"))
    return j.withColumn("p", p)


def corpus_cross_entropy(counts: dict[str, DataFrame], model: dict[str, DataFrame]) -> DataFrame:
    """A9 on the training positions, from the count table alone: every
    position with the same (c2, c1, token) has the same probability, so
    sum(cnt * -ln p) / sum(cnt) is the mean over positions."""
    pp = position_probabilities(counts["full"], model)
    cost = F.sum(F.col("cnt") * -F.log("p"))
    return pp.agg((cost / F.sum("cnt")).alias("cross_entropy"), F.sum("cnt").alias("n_tokens"))


def argmax_tables(model: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Most likely next token per context of each order. Seen
    continuations always beat unseen ones (a count of 1 outweighs any
    backed-off probability below 1), so the argmax runs over observed
    n-grams only; ties go to the smallest token."""
    def best(df: DataFrame, keys: list[str], score: Column) -> DataFrame:
        g = df.groupBy(*keys) if keys else df.groupBy()
        r = g.agg(F.min(F.struct((-score).alias("s"), F.col("token").alias("t"))).alias("_b"))
        return r.select(*keys, F.col("_b.t").alias("next_token"))

    return {"a2": best(model["p2"], ["c2", "c1"], F.col("p2")),
            "a1": best(model["p1"], ["c1"], F.col("p1")),
            "a0": best(model["p0"], [], F.col("p0"))}


def greedy_next_tokens(contexts: DataFrame, key: str, tables: dict[str, DataFrame], k: int = 5) -> DataFrame:
    """M2: predict ``k`` tokens greedily from each row's last two tokens
    (``t``, ``u``), backing off from order 2 to 1 to 0.

    Many rows share a context, and the answer depends on the context alone:
    the steps run once for each distinct (t, u), and one join gives the rows
    their answers. A step is a join round with the argmax tables; the order-0
    answer is one row, broadcast."""
    tables = {name: hold(t) for name, t in tables.items()}
    a0 = F.broadcast(tables["a0"].select(F.col("next_token").alias("_a0")))
    etype = contexts.schema["u"].dataType.simpleString()
    own = contexts.select("t", "u").distinct()
    cur = own.select(F.col("t").alias("_t0"), F.col("u").alias("_u0"), "t", "u", F.array().cast(f"array<{etype}>").alias("predicted")).crossJoin(a0)
    for _ in range(k):
        a2 = tables["a2"].select(F.col("c2").alias("t"), F.col("c1").alias("u"), F.col("next_token").alias("_n2"))
        a1 = tables["a1"].select(F.col("c1").alias("u"), F.col("next_token").alias("_n1"))
        step = cur.join(a2, ["t", "u"], "left").join(a1, "u", "left")
        nxt = F.coalesce(F.col("_n2"), F.col("_n1"), F.col("_a0"))
        cur = step.select("_t0", "_u0", F.col("u").alias("t"), nxt.alias("u"), F.array_append("predicted", nxt).alias("predicted"), "_a0")
    done = cur.select("_t0", "_u0", "predicted")
    return contexts.join(done, F.col("t").eqNullSafe(F.col("_t0")) & F.col("u").eqNullSafe(F.col("_u0"))).select(key, "predicted")


def training_part(seqs: DataFrame, key: str, n: int, least: int) -> DataFrame:
    """The sequences without the tails that ``holdout`` takes: the last ``n``
    tokens of every sequence longer than ``least``."""
    return S.drop_tail(seqs.where(F.col("seq_len") > least), key, n).unionByName(
        seqs.where(F.col("seq_len") <= least).select(key, "chunk", "offset", "seq_len", "tokens"))


def holdout_contexts(seqs: DataFrame, key: str, n: int) -> tuple[DataFrame, DataFrame]:
    """Inputs for M2/M3: the last two tokens before the held-out tail, and the tail."""
    inp, actual = S.holdout(seqs, key, n)
    last2 = S.tail_tokens(inp, key, 2)
    ctx = last2.select(key, F.when(F.size("tokens") >= 2, F.element_at("tokens", -2)).alias("t"),
                       F.element_at("tokens", -1).alias("u"))
    return ctx, actual


def next_token_accuracy(predicted: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """M3: per position 1..k, the share of rows whose prediction is right."""
    j = predicted.join(actual, key)
    hits = F.zip_with("predicted", "actual", lambda p, a: F.when(p == a, 1.0).otherwise(0.0))
    ex = j.select(F.posexplode(hits).alias("i", "hit"))
    return ex.groupBy((F.col("i") + 1).alias("position")).agg(F.avg("hit").alias("accuracy"),
                                                              F.count(F.lit(1)).alias("n"))
