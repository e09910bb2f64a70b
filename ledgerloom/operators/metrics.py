"""Exact evaluation metrics as aggregates.

Every metric is a plain aggregate (partial aggregation map-side) or, for
ROC AUC, a pre-aggregation to distinct scores followed by a distributed
prefix sum; nothing is collected to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.session import default_parallelism, hold


def sigmoid(x) -> Column:
    """1 / (1 + exp(-x))."""
    c = F.col(x) if isinstance(x, str) else x
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-c))


def bce_with_logits_terms(logit, label) -> Column:
    """Per-row binary cross-entropy on a logit, the stable form
    max(x,0) - x*y + log1p(exp(-|x|))."""
    x = F.col(logit) if isinstance(logit, str) else logit
    y = (F.col(label) if isinstance(label, str) else label).cast("double")
    return F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))


def bce_with_logits(df: DataFrame, logit: str = "logit", label: str = "label") -> DataFrame:
    """A10: mean binary cross-entropy."""
    return df.agg(F.avg(bce_with_logits_terms(logit, label)).alias("bce"))


def class_cross_entropy_terms(logits: str, label: str) -> Column:
    """Per-row cross-entropy over class logits (ARRAY<DOUBLE>):
    logsumexp(z) - z[label], computed with the row max for stability."""
    z = F.col(logits)
    m = F.array_max(z)
    lse = F.log(F.aggregate(z, F.lit(0.0), lambda acc, v: acc + F.exp(v - m))) + m
    return lse - F.element_at(z, F.col(label).cast("int") + 1)


def cross_entropy(df: DataFrame, prob: str = "p", target: str = "y", ignore: int = -1) -> DataFrame:
    """Mean of -log p(target) over targets that are not ``ignore``."""
    kept = df.where(F.col(target) != F.lit(ignore))
    return kept.agg(F.avg(-F.log(F.col(prob))).alias("cross_entropy"),
                    F.count(F.lit(1)).alias("n_tokens"))


def mean_of_batch_means(df: DataFrame, value: str, batch: str = "batch_id") -> DataFrame:
    """Per-batch mean, then the mean over batches (a short last batch
    weighs as much as a full one)."""
    per = df.groupBy(batch).agg(F.avg(value).alias("_bm"))
    return per.agg(F.avg("_bm").alias("mean_of_batch_means"), F.count(F.lit(1)).alias("n_batches"))


def roc_auc(df: DataFrame, score: str = "score", label: str = "label",
            num_partitions: int | None = None) -> DataFrame:
    """Exact ROC AUC with ties averaged (Mann-Whitney U / (P*N)).

    1. pre-aggregate to (score, pos, neg): map-side combined;
    2. range-partition the distinct scores and sort; each partition's
       negatives (one row per partition) give broadcast prefix offsets;
    3. negatives below each score = partition offset + running sum inside
       the partition, both from one range shuffle; then one aggregate.

    Where one of the classes has no row, the area is not defined: ``auc`` is null.
    """
    n = num_partitions or default_parallelism(df.sparkSession)
    y = F.col(label).cast("int")
    per = (df.where(F.col(score).isNotNull() & y.isNotNull())
           .groupBy(score).agg(F.sum(F.when(y == 1, 1).otherwise(0)).cast("double").alias("pos"),
                               F.sum(F.when(y == 1, 0).otherwise(1)).cast("double").alias("neg")))
    # _p is an alias of what the rows are partitioned by; each partition is one _p
    ranged = hold(per.repartitionByRange(n, score).withColumn("_p", F.spark_partition_id()))
    part = ranged.groupBy("_p").agg(F.sum("neg").alias("_pn"))
    offs = part.select("_p", F.coalesce(F.sum("_pn").over(
        Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("_off"))
    local = F.sum("neg").over(Window.partitionBy("_p").orderBy(score)
                               .rowsBetween(Window.unboundedPreceding, -1))
    below = ranged.withColumn("_below", F.coalesce(local, F.lit(0.0))) \
                  .join(F.broadcast(offs), "_p")
    u = F.sum(F.col("pos") * (F.col("_off") + F.col("_below") + F.col("neg") / 2.0))
    tot = below.agg(u.alias("_u"), F.sum("pos").alias("_P"), F.sum("neg").alias("_N"))
    return tot.select(F.try_divide(F.col("_u"), F.col("_P") * F.col("_N")).alias("auc"),
                      F.col("_P").cast("bigint").alias("n_pos"), F.col("_N").cast("bigint").alias("n_neg"))


def evaluate_scores(df: DataFrame, logit: str = "logit", label: str = "label") -> DataFrame:
    """M7: one report row: rows, mean BCE, accuracy at p >= 0.5, ROC AUC."""
    base = df.agg(F.count(F.lit(1)).alias("n"),
                  F.avg(bce_with_logits_terms(logit, label)).alias("bce"),
                  F.avg(F.when((sigmoid(logit) >= 0.5) == (F.col(label) == 1), 1.0).otherwise(0.0)).alias("accuracy"))
    auc = roc_auc(df.select(F.col(logit).alias("score"), F.col(label).alias("label")))
    return base.crossJoin(F.broadcast(auc.select("auc")))  # one row each
