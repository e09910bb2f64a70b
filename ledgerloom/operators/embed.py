"""Vectors for tokens, users and tabular rows.

Embedding tables are *given* (the ``embeddings`` table), not trained by
back-propagation. Pooling counts positions by (key, id) before anything is
joined, so a user with a third of all tokens is reduced in every map task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.joins import salted_lookup, travels


def embedding_lookup(ids_long: DataFrame, table: DataFrame, id_col: str = "token_id",
                     vec_id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """Attach the vector of ``id`` to every (..., token_id) row; an id
    without a vector gets null.

    Ids repeat without bound (a separator is a tenth of all positions), so
    the rows are salted and the table, one row an id, is repeated as often:
    no id meets in one task. A table counted as small travels to the rows."""
    t = table.select(F.col(vec_id).cast("bigint").alias("_vec"), F.col(vec_id).alias("vec_id"), F.col(vec).alias("embedding"))
    return salted_lookup(ids_long.withColumn("_id", F.col(id_col).cast("bigint")), t, "_id", "_vec", light=travels(t, "_vec", "embedding")).drop("_id")


def pool_mean(ids_long: DataFrame, table: DataFrame, key: str, id_col: str = "token_id", vec_id: str = "vec_id",
              vec: str = "embedding") -> DataFrame:
    """A14 (mean): (key, dim, value), the mean vector of a key's positions.

    Positions are first counted by (key, id), combined map-side, so the
    join and the vector arithmetic see each id of a key once, weighted.
    Positions without a vector do not count."""
    n = ids_long.groupBy(key, F.col(id_col).alias("token_id")).agg(F.count(F.lit(1)).alias("_n"))
    v = embedding_lookup(n, table, "token_id", vec_id, vec).where(F.col("embedding").isNotNull())
    return mean_vectors(v, key, "embedding", "_n", vector_sizes(table, vec))


def vector_sizes(table: DataFrame, vec: str) -> tuple[int, int]:
    """The shortest and the longest vector of a table (0, 0 without any)."""
    return tuple(x or 0 for x in table.where(F.col(vec).isNotNull()).agg(F.min(F.size(vec)), F.max(F.size(vec))).first())


def mean_vectors(rows: DataFrame, key: str, vec: str, weight: str, sizes: tuple[int, int]) -> DataFrame:
    """(key, dim, value): the weighted mean of a key's vectors, one sum a
    dimension side by side, so a vector stays one row until its key's sums are
    done. A dimension's weights are those of the vectors that reach it."""
    shortest, longest = sizes
    if not longest:
        return rows.select(key, F.lit(0).alias("dim"), F.lit(0.0).alias("value")).limit(0)
    sums = [F.sum(F.get(vec, F.lit(d)).cast("double") * F.col(weight)).alias(f"_s{d}") for d in range(longest)]
    reach = [F.sum(weight).alias("_n")] if shortest == longest else [F.sum(F.when(F.size(vec) > d, F.col(weight))).alias(f"_n{d}") for d in range(longest)]
    n = [F.col("_n")] * longest if shortest == longest else [F.col(f"_n{d}") for d in range(longest)]
    each = F.array(*[F.struct(n[d].alias("n"), (F.col(f"_s{d}") / n[d]).alias("value")) for d in range(longest)])
    return rows.groupBy(key).agg(*sums, *reach).select(key, F.posexplode(each).alias("dim", "_m")) \
               .where(F.col("_m.n").isNotNull()).select(key, "dim", F.col("_m.value").alias("value"))


def pool_last(ids_long: DataFrame, table: DataFrame, key: str, pos: str = "pos", id_col: str = "token_id",
              vec_id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """A14 (last): (key, dim, value), the vector at each key's last position
    that has one. The last position of each (key, id) is taken first, so one
    vector is looked up per id of a key, not per position."""
    last = ids_long.groupBy(key, F.col(id_col).alias("token_id")).agg(F.max(pos).alias("_pos"))
    v = embedding_lookup(last, table, "token_id", vec_id, vec).where(F.col("embedding").isNotNull())
    return v.groupBy(key).agg(F.max_by("embedding", "_pos").alias("_v")).select(key, F.posexplode("_v").alias("dim", "value"))


def projected_users(ids_long: DataFrame, key: str, token: str = "token", dims: int = 16) -> DataFrame:
    """M4: (key, dim, value): a user's mean random projection of its tokens.
    Each token has a fixed vector of signs, read off the digits of its md5,
    so no vocabulary is held anywhere; all positions count, through one
    map-side combined aggregate."""
    if dims > 32:
        raise ValueError("an md5 has 32 digits")
    h = F.md5(F.col(token).cast("string"))
    signs = [F.when(F.substring(h, d + 1, 1) >= "8", F.lit(1)).otherwise(F.lit(-1)) for d in range(dims)]
    sums = ids_long.where(F.col(token).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(s).alias(f"_s{d}") for d, s in enumerate(signs)])
    return sums.select(key, F.posexplode(F.array(*[F.col(f"_s{d}") / F.col("_n") for d in range(dims)])).alias("dim", "value"))


def periodic_features(cols: Sequence[str], n_freq: int, freq: Sequence[Sequence[float]],
                      bias: Sequence[Sequence[float]]) -> Column:
    """sin(f_ij * x_i + b_ij) for every column i and frequency j,
    flattened to len(cols) * n_freq values. ``freq``/``bias`` are the given
    parameters (seeded, not trained here)."""
    out = []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        for j in range(n_freq):
            out.append(F.sin(x * F.lit(float(freq[i][j])) + F.lit(float(bias[i][j]))))
    return F.array(*out)


def cross_features(cols: Sequence[str]) -> Column:
    """P16 (re-aimed): explicit pairwise products x_i * x_j, i <= j."""
    out = []
    for i in range(len(cols)):
        for j in range(i, len(cols)):
            out.append(F.col(cols[i]).cast("double") * F.col(cols[j]).cast("double"))
    return F.array(*out)
