"""Deterministic splits, shuffles, batches and padding.

Random draws are md5 hashes of (seed, epoch, id): identical in every engine
and independent of partitioning. Global positions come from
``global_index`` (range shuffle + broadcast per-partition offsets), never
from a window without a partition clause.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.ranking import global_index


def hash_order(seed: int, id_col: str, epoch: int | None = None) -> Column:
    """md5 of ``seed|[epoch|]id``, a reproducible random order key."""
    parts = [F.lit(str(seed))] + ([F.lit(str(epoch))] if epoch is not None else []) + \
        [F.col(id_col).cast("string")]
    return F.md5(F.concat_ws("|", *parts))


def hash_percent(col: str) -> Column:
    """0..99 from the first 8 hex digits of md5(value)."""
    return F.conv(F.substring(F.md5(F.col(col).cast("string")), 1, 8), 16, 10).cast("bigint") % 100


def group_split(df: DataFrame, group_col: str = "user_id", test_percent: int = 20) -> DataFrame:
    """A whole group on one side only (no user in train and test)."""
    return df.withColumn("is_test", hash_percent(group_col) < F.lit(test_percent))


def class_quotas(counts: DataFrame, label: str, n_test: Column) -> DataFrame:
    """Largest-remainder split of ``n_test`` over classes (ties by label)."""
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    exact = F.col("_nt") * F.col("n") / F.col("_tot")
    q = (counts.withColumn("_tot", total).withColumn("_nt", n_test)
         .withColumn("_base", F.floor(exact)).withColumn("_frac", exact - F.floor(exact)))
    rest = F.col("_nt") - F.sum("_base").over(Window.partitionBy(F.lit(1)))
    rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("_frac"), F.col(label)))
    return q.withColumn("quota", (F.col("_base") + F.when(rank <= rest, 1).otherwise(0)).cast("bigint")) \
            .select(label, "n", "quota")


def stratified_split(df: DataFrame, label: str = "label", id_col: str = "row_id", test_size: float = 0.2,
                     seed: int = 42) -> DataFrame:
    """Exact stratified split: ``ceil(test_size * n)`` test rows shared
    over classes by largest remainder; inside a class the rows with the
    smallest md5(seed|id) go to test. Rows without a label are a class of their own.

    The per-class rank is a global position in (label, hash) order minus the
    class's start, so no class is ranked inside a single task. The class
    table has one row per label value (a handful) and is broadcast."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    n_total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    # exact decimal product, so ceil(0.2 * 1875) is 375 in every engine
    quotas = class_quotas(counts, label, F.ceil(n_total * F.lit(Decimal(str(test_size)))).cast("bigint"))
    starts = quotas.withColumn(
        "_start", F.coalesce(F.sum("n").over(Window.orderBy(label).rowsBetween(Window.unboundedPreceding, -1)),
                             F.lit(0)))
    h = df.withColumn("_h", hash_order(seed, id_col))
    idx = global_index(h, [label, "_h", id_col], name="_gpos")
    s = starts.select(F.col(label).alias("_label"), "_start", "quota")
    j = idx.join(F.broadcast(s), F.col(label).eqNullSafe(F.col("_label"))).drop("_label")
    return j.withColumn("is_test", (F.col("_gpos") - F.col("_start")) < F.col("quota")) \
            .drop("_h", "_gpos", "_start", "quota")


def assign_batches(df: DataFrame, id_col: str, batch_size: int, seed: int = 42, epoch: int = 0,
                   shuffle: bool = True) -> DataFrame:
    """W7 + W8: fixed-size batches (the last may be short) in a seeded
    shuffle order (or ``id`` order when ``shuffle`` is False)."""
    if shuffle:
        df = df.withColumn("_h", hash_order(seed, id_col, epoch))
        order = ["_h", id_col]
    else:
        order = [id_col]
    out = global_index(df, order, name="position")
    out = out.withColumn("batch_id", F.floor(F.col("position") / F.lit(batch_size)).cast("bigint"))
    return out.drop("_h") if shuffle else out


def pad_batches(batched: DataFrame, x_col: str = "x", y_col: str = "y", x_pad: int = 0,
                y_pad: int = -1) -> DataFrame:
    """Right-pad x with ``x_pad`` and y with ``y_pad`` to the longest x
    of the row's batch (batches are bounded by the batch size)."""
    m = F.max(F.size(x_col)).over(Window.partitionBy("batch_id"))
    out = batched.withColumn("_m", m)
    pad = lambda c, v: F.concat(F.col(c), F.array_repeat(F.lit(v), (F.col("_m") - F.size(c)).cast("int")))
    return out.withColumn(x_col, pad(x_col, x_pad)).withColumn(y_col, pad(y_col, y_pad)) \
              .withColumnRenamed("_m", "batch_len")


# ---------------------------------------------------------------------------
# Epoch orders as expressions

ROUNDS = 24
_MODULUS = (1 << 31) - 1


def round_constants(seed: int, epoch: int) -> list[tuple[int, int, int]]:
    """(key, factor, shift) of each round of an epoch's permutation, from md5(seed|epoch|round)."""
    out = []
    for r in range(ROUNDS):
        h = hashlib.md5(f"{seed}|{epoch}|{r}".encode()).hexdigest()
        out.append((int(h[:12], 16), int(h[12:17], 16) | 1, int(h[17:24], 16)))
    return out


def permuted(position: Column, n: Column, seed: int, epoch: int) -> Column:
    """A keyed bijection of 0 .. n - 1 (below 2**40), as an expression.

    Each round pairs x with (key - x) mod n and swaps the two if a keyed bit of
    the larger one is set (swap-or-not): every round is a bijection for any n,
    so unlike in a power-of-two network nothing has to be walked back into
    range."""
    rounds = F.array(*[F.struct(F.lit(k).cast("bigint").alias("key"), F.lit(f).cast("bigint").alias("factor"), F.lit(s).cast("bigint").alias("shift"))
                       for k, f, s in round_constants(seed, epoch)])

    def swapped(x: Column, r: Column) -> Column:
        other = F.pmod(r["key"] % n - x, n)
        bit = F.shiftright((F.greatest(x, other) * r["factor"] + r["shift"]) % F.lit(_MODULUS), 13) % 2
        return F.when(bit == 1, other).otherwise(x)

    return F.aggregate(rounds, position.cast("bigint"), swapped)


def epoch_batches(numbered: DataFrame, batch_size: int, seed: int, epochs: int, position: str = "position") -> DataFrame:
    """W7 + W8 for many epochs on rows that hold their position 0 .. n - 1: each
    epoch's order and batch id is an expression of the stored position, so no
    epoch sorts or shuffles the table (the row count is one broadcast number).
    All batches of an epoch but the last have ``batch_size`` rows."""
    n = F.broadcast(numbered.agg(F.count(F.lit(1)).alias("_n")))  # one row
    orders = F.array(*[F.struct(F.lit(e).alias("epoch"), permuted(F.col(position), F.col("_n"), seed, e).alias("shuffled")) for e in range(epochs)])
    out = numbered.crossJoin(n).select(*numbered.columns, F.explode(orders).alias("_e")).select(*numbered.columns, "_e.*")
    return out.withColumn("batch_id", F.floor(F.col("shuffled") / F.lit(batch_size)).cast("bigint"))


# ---------------------------------------------------------------------------
# Batches of rows of like length

def length_buckets(lengths: DataFrame, n_buckets: int, budget: int, length: str = "length") -> DataFrame:
    """(length, bucket, batch_rows, first, first_batch) of every length that
    occurs: ``n_buckets`` quantiles of the rows by length (exact: there are at
    most as many lengths as the context window is long, so one small table
    is the whole distribution). A bucket's batches hold as many rows as its
    longest fit ``budget`` padded tokens, at least one."""
    by_len = lengths.groupBy(length).agg(F.count(F.lit(1)).alias("n"))
    all_ = Window.partitionBy(F.lit(1))  # one row a length
    before = F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(1)).orderBy(length).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = by_len.withColumn("bucket", F.floor(before * n_buckets / F.sum("n").over(all_)).cast("int"))
    per = cut.groupBy("bucket").agg(F.sum("n").alias("_rows"), F.max(length).alias("_top"))
    rows = F.greatest(F.floor(F.lit(budget) / F.greatest(F.col("_top"), F.lit(1))), F.lit(1)).cast("bigint")
    per = per.withColumn("batch_rows", rows)
    upto = Window.partitionBy(F.lit(1)).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("first", F.coalesce(F.sum("_rows").over(upto), F.lit(0)).cast("bigint")) \
             .withColumn("first_batch", F.coalesce(F.sum(F.ceil(F.col("_rows") / F.col("batch_rows"))).over(upto), F.lit(0)).cast("bigint"))
    return cut.join(per, "bucket").select(length, "bucket", "batch_rows", "first", "first_batch")


def packed_batches(rows: DataFrame, id_col: str, n_buckets: int = 16, budget: int = 8192, seed: int = 42, epoch: int = 0, length: str = "length") -> DataFrame:
    """Batches of rows of like length: ``rows`` (id, length) with bucket and
    batch_id, in a seeded order inside each bucket. No batch has more padded
    tokens (rows * longest) than ``budget``, unless it is a single row. Only ids
    and lengths are sorted; the table of lengths has one row a length
    (at most the context window) and is broadcast."""
    buckets = length_buckets(rows, n_buckets, budget, length)
    marked = rows.join(F.broadcast(buckets), length).withColumn("_h", hash_order(seed, id_col, epoch))
    placed = global_index(marked, ["bucket", "_h", id_col], name="_at")
    batch = F.col("first_batch") + F.floor((F.col("_at") - F.col("first")) / F.col("batch_rows"))
    return placed.withColumn("batch_id", batch.cast("bigint")).drop("_h", "_at", "first", "first_batch", "batch_rows")


def padding_share(batched: DataFrame, length: str = "length") -> DataFrame:
    """One row: batches, tokens, padded tokens (rows * longest of each batch) and their ratio."""
    per = batched.groupBy("batch_id").agg(F.sum(length).alias("_t"), (F.max(length) * F.count(F.lit(1))).alias("_p"))
    return per.agg(F.count(F.lit(1)).alias("n_batches"), F.sum("_t").cast("bigint").alias("tokens"), F.sum("_p").cast("bigint").alias("padded_tokens")) \
              .withColumn("padding", F.lit(1.0) - F.try_divide(F.col("tokens").cast("double"), F.col("padded_tokens").cast("double")))


def sample_k(df: DataFrame, id_col: str, k: int, seed: int = 42) -> DataFrame:
    """O2: k rows in seeded random order (the sampling feature itself; the
    planner runs it as a bounded top-k, TakeOrderedAndProject)."""
    return df.withColumn("_h", hash_order(seed, id_col)).orderBy("_h", id_col).limit(k).drop("_h")

