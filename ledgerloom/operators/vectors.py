"""Token vectors learned from co-occurrence (M4).

1. ``cooccurrences`` counts ordered token pairs at most ``window`` places apart
   in the sequences (combined in the tasks), also across chunk borders;
2. ``ppmi`` turns them into positive pointwise mutual information, a sparse
   symmetric matrix with one row and column a token;
3. ``token_vectors`` factorises it by randomised subspace iteration: the matrix
   stays in Spark, dealt by row; every step multiplies each partition's block
   with a thin matrix that travels with the tasks, and the product's rows
   come back. Thin matrices have one row a token and ``rank`` + 10 columns:
   their size is bounded by the vocabulary, which is checked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.embed import mean_vectors, vector_sizes
from ledgerloom.operators.joins import salted_lookup, travels
from ledgerloom.session import drop_written, hold, written

MOST_TOKENS = 200_000  # 200,000 * 74 doubles: 118 MB in a task
EXTRA = 10             # columns beyond the rank


def cooccurrences(seqs: DataFrame, key: str, window: int = 2) -> DataFrame:
    """(left, right, cnt): pairs of tokens ``left`` before ``right`` by 1 to ``window``
    places of one sequence. Pairs inside a chunk are counted where it lies; for
    those across its border only the last ``window`` tokens of the chunk before it
    and its own first ones meet, by an equi-join on (key, chunk). All distances are
    counted in one pass, and only the pairs leave a chunk, not its tokens with each."""
    tail = F.slice("tokens", F.greatest(F.size("tokens") - window, F.lit(0)) + 1, window)
    last = seqs.select(key, (F.col("chunk") + 1).alias("chunk"), tail.alias("_before"))
    first = seqs.where(F.col("chunk") > 0).select(key, "chunk", F.slice("tokens", 1, window).alias("_own"))
    border = first.join(last, [key, "chunk"]).select(F.size("_before").alias("_b"), F.concat("_before", "_own").alias("_t"))
    out = None
    for whole, across in ((seqs.select(F.lit(0).alias("_b"), F.col("tokens").alias("_t")), False), (border, True)):
        # across a border: the left token before it, the right one behind it
        pairs = [_pairs("_t", F.greatest(F.col("_b"), F.lit(d)), F.least(F.size("_t") - 1, F.col("_b") + d - 1) if across else F.size("_t") - 1, d)
                 for d in range(1, window + 1)]
        one = whole.select(F.explode(F.concat(*pairs)).alias("_p")).select(F.col("_p")["0"].alias("left"), F.col("_p")["1"].alias("right"))
        one = one.where(F.col("left").isNotNull() & F.col("right").isNotNull()).groupBy("left", "right").agg(F.count(F.lit(1)).alias("cnt"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("left", "right").agg(F.sum("cnt").alias("cnt"))


def _pairs(tokens: str, low: Column, high: Column, d: int) -> Column:
    """(token ``d`` places before, token) at the places ``low`` to ``high`` of an array."""
    n = F.greatest(high - low + 1, F.lit(0))
    return F.arrays_zip(F.slice(tokens, low + 1 - d, n), F.slice(tokens, low + 1, n))


def ppmi(counts: DataFrame) -> DataFrame:
    """(a, b, value): positive pointwise mutual information of the counts taken
    both ways, ln(c(a, b) * n / (c(a) * c(b))) where that is above 0. The
    marginals of frequent tokens are looked up with salt."""
    ways = F.explode(F.array(F.struct(F.col("left").alias("a"), F.col("right").alias("b")), F.struct(F.col("right").alias("a"), F.col("left").alias("b"))))
    both = hold(counts.select(ways.alias("_p"), "cnt").groupBy(F.col("_p.a").alias("a"), F.col("_p.b").alias("b")).agg(F.sum("cnt").alias("cnt")))
    of = both.groupBy("a").agg(F.sum("cnt").alias("_m"))
    total = F.broadcast(both.agg(F.sum("cnt").alias("_n")))  # one row
    j = salted_lookup(both, of.select(F.col("a").alias("_ta"), F.col("_m").alias("_ma")), "a", "_ta", "inner")
    j = salted_lookup(j, of.select(F.col("a").alias("_tb"), F.col("_m").alias("_mb")), "b", "_tb", "inner").crossJoin(total)
    value = F.log(F.col("cnt").cast("double") * F.col("_n") / (F.col("_ma").cast("double") * F.col("_mb")))
    return j.select("a", "b", value.alias("value")).where(F.col("value") > 0)


def _product(matrix: DataFrame, thin: np.ndarray) -> np.ndarray:
    """matrix @ thin, block by block: the matrix is dealt by row, so a task gives whole rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, cols, values = [], [], []
        for b in batches:
            for out, c in zip((rows, cols, values), b.columns):
                out.append(c.to_numpy(zero_copy_only=False))
        if not rows:
            return
        i, j, v = (np.concatenate(x) for x in (rows, cols, values))
        names, at = np.unique(i, return_inverse=True)
        out = np.zeros((len(names), thin.shape[1]))
        step = max((1 << 22) // thin.shape[1], 1)
        for lo in range(0, len(i), step):
            np.add.at(out, at[lo:lo + step], v[lo:lo + step, None] * thin[j[lo:lo + step]])
        yield pa.RecordBatch.from_arrays([pa.array(names.astype(np.int64)), pa.array(list(out), pa.list_(pa.float64()))], names=["i", "row"])

    made = np.zeros((len(thin), thin.shape[1]))
    got = matrix.mapInArrow(run, "i long, row array<double>").toArrow()  # one row a token
    if len(got):
        made[got.column("i").to_numpy()] = np.stack([np.asarray(r) for r in got.column("row").to_pylist()])
    return made


def factors(matrix: DataFrame, tokens: list[str], rank: int, steps: int = 6, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues by size, eigenvectors as columns) of the symmetric ``matrix`` (i, j,
    value), by subspace iteration from a seeded random start."""
    n = len(tokens)
    width = min(rank + EXTRA, n)
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((n, width)))
    for _ in range(steps):
        q, _ = np.linalg.qr(_product(matrix, q))
    small = q.T @ _product(matrix, q)
    value, vec = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-np.abs(value))[:rank]
    vectors = q @ vec[:, order]
    largest = np.abs(vectors).argmax(axis=0)
    signs = np.sign(vectors[largest, np.arange(vectors.shape[1])])
    return value[order], vectors * np.where(signs == 0, 1, signs)


def token_vectors(ppmi_table: DataFrame, rank: int = 16, steps: int = 6, seed: int = 42) -> DataFrame:
    """(token, vector): eigenvectors of the PPMI matrix scaled by the root of the
    eigenvalues' size, so that inner products approximate the matrix. Tokens
    without a positive value have no vector; an empty table gives none."""
    spark = ppmi_table.sparkSession
    schema = "token string, vector array<double>"
    path, table = written(ppmi_table, "ppmi")
    dealt = None
    try:
        names = table.select(F.col("a").alias("t")).unionByName(table.select(F.col("b").alias("t"))).distinct().orderBy("t").limit(MOST_TOKENS + 1)
        tokens = [r["t"] for r in names.collect()]
        if len(tokens) > MOST_TOKENS:
            raise ValueError(f"more than {MOST_TOKENS} tokens: learn a smaller vocabulary first")
        if not tokens:
            return spark.createDataFrame([], schema)
        ids = F.broadcast(spark.createDataFrame(list(enumerate(tokens)), "id long, t string"))  # MOST_TOKENS rows at most
        coded = table.join(ids, F.col("a") == F.col("t")).select(F.col("id").alias("i"), "b", "value").join(ids, F.col("b") == F.col("t")).select("i", F.col("id").alias("j"), "value")
        dealt, matrix = written(coded.repartition("i"), "matrix")
        matrix = matrix.repartition("i").persist()
        try:
            value, vectors = factors(matrix, tokens, min(rank, len(tokens)), steps, seed)
        finally:
            matrix.unpersist()
    finally:
        drop_written(spark, path)
        if dealt:
            drop_written(spark, dealt)
    scaled = vectors * np.sqrt(np.abs(value))
    return spark.createDataFrame([(t, row.tolist()) for t, row in zip(tokens, scaled)], schema)


def pooled(seqs: DataFrame, key: str, vectors: DataFrame) -> DataFrame:
    """(key, dim, value): mean vector of a key's tokens that have one. Vectors that
    travel are summed up where the chunks lie: a shuffle moves one row of sums a
    key and task. Heavier ones are looked up, with salt, by counted tokens."""
    one = seqs.select(key, F.explode("tokens").alias("token"))
    light = travels(vectors, "token", "vector")
    bag = one.withColumn("cnt", F.lit(1)) if light else one.groupBy(key, "token").agg(F.count(F.lit(1)).alias("cnt"))
    j = salted_lookup(bag, vectors.select(F.col("token").alias("_t"), "vector"), "token", "_t", "inner", light)
    return mean_vectors(j, key, "vector", "cnt", vector_sizes(vectors, "vector"))
