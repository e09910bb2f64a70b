"""Classifiers over sequences and tabular features with Spark ML (M4-M8).

The reference fine-tunes a transformer (sequence only, or fused with a
tabular tower). Re-aimed for Spark in two forms. Count classifiers (naive
Bayes over token counts, categories and numericals) are closed-form: their
weights are a few aggregates, their scores a join and a sum, and SQL says
the same. The Spark ML pipelines learn one estimator (logistic regression or
gradient-boosted trees) from hashed token counts, one-hot codes, numericals,
periodic and crossed features; hashing holds no vocabulary and drops no token.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import HashingTF, OneHotEncoder, VectorAssembler, VectorSizeHint
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.operators.joins import salted_lookup
from ledgerloom.session import hold


@dataclass
class ClassifierConfig:
    estimator: str = "logistic"  # "logistic" | "gbt"
    hash_size: int = 1 << 18
    max_iter: int = 50
    reg_param: float = 0.01
    seed: int = 42


def _sequence_stages(cfg: ClassifierConfig, tokens: str, out: str) -> list:
    return [HashingTF(inputCol=tokens, outputCol=out, numFeatures=cfg.hash_size)]


def _estimator(cfg: ClassifierConfig, features: str, label: str):
    if cfg.estimator == "gbt":
        return GBTClassifier(featuresCol=features, labelCol=label, maxIter=cfg.max_iter, seed=cfg.seed)
    return LogisticRegression(featuresCol=features, labelCol=label, maxIter=cfg.max_iter, regParam=cfg.reg_param)


def sequence_classifier(cfg: ClassifierConfig, tokens: str = "tokens", label: str = "label") -> Pipeline:
    """M5: tokens -> hashed counts -> classifier."""
    return Pipeline(stages=_sequence_stages(cfg, tokens, "seq_vec") + [_estimator(cfg, "seq_vec", label)])


def fusion_classifier(cfg: ClassifierConfig, cat_cols: Sequence[str], num_cols: Sequence[str],
                      extra_vectors: dict[str, int] | None = None, tokens: str = "tokens",
                      label: str = "label") -> Pipeline:
    """M6: sequence vector + one-hot categoricals + numericals (+ periodic /
    crossed feature vectors of known sizes) concatenated, one estimator on top."""
    extra_vectors = extra_vectors or {}
    extra_vector_cols = list(extra_vectors)
    hints = [VectorSizeHint(inputCol=c, size=n, handleInvalid="optimistic") for c, n in extra_vectors.items()]
    onehot = OneHotEncoder(inputCols=list(cat_cols), outputCols=[f"{c}_oh" for c in cat_cols], handleInvalid="keep")
    asm = VectorAssembler(inputCols=["seq_vec"] + [f"{c}_oh" for c in cat_cols] + list(num_cols)
                          + list(extra_vector_cols), outputCol="features", handleInvalid="keep")
    return Pipeline(stages=_sequence_stages(cfg, tokens, "seq_vec") + hints
                    + [onehot, asm, _estimator(cfg, "features", label)])


def scores(model: PipelineModel, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """M7/M8: positive-class probability and its logit for every row."""
    out = model.transform(df)
    p1 = vector_to_array("probability")[1]
    p1c = F.least(F.greatest(p1, F.lit(1e-12)), F.lit(1 - 1e-12))
    return out.select(*keep, p1.alias("probability"), F.log(p1c / (F.lit(1.0) - p1c)).alias("logit"))


def token_weights(counts: DataFrame, token: str = "token", pos: str = "pos", neg: str = "neg") -> DataFrame:
    """Naive Bayes with add-one smoothing: (token, weight = ln P(t|1) - ln P(t|0))
    from the tokens' counts in either class (all training tokens are kept)."""
    tot = counts.agg(F.sum(pos).alias("_n1"), F.sum(neg).alias("_n0"), F.count(F.lit(1)).alias("_v"))
    w = F.log((F.col(pos) + 1.0) / (F.col("_n1") + F.col("_v"))) - F.log((F.col(neg) + 1.0) / (F.col("_n0") + F.col("_v")))
    return counts.crossJoin(F.broadcast(tot)).select(token, w.alias("weight"))  # one row


def class_prior(train: DataFrame, pos: str = "pos", neg: str = "neg") -> DataFrame:
    """One row, prior: ln of the smoothed class ratio."""
    return train.agg(F.log((F.coalesce(F.sum(pos), F.lit(0)) + 1.0) / (F.coalesce(F.sum(neg), F.lit(0)) + 1.0)).alias("prior"))


def token_scores(bag: DataFrame, weights: DataFrame, key: str, token: str = "token", cnt: str = "cnt") -> DataFrame:
    """(key, score): sum of cnt * weight over a key's known tokens. Frequent
    tokens are salted; sums are combined map-side."""
    j = salted_lookup(bag.select(key, token, cnt), weights.select(F.col(token).alias("_t"), "weight"), token, "_t", "inner")
    return j.groupBy(key).agg(F.sum(F.col(cnt) * F.col("weight")).alias("score"))


def bag_classifier(rows: DataFrame, bag: DataFrame, key: str, label: str = "label", test: str = "is_test") -> DataFrame:
    """M5: a logit for every row of ``rows`` (key, label or null, is_test) from
    its token counts ``bag`` (key, token, cnt). Learns from the labelled rows
    outside the test part; a row without known tokens gets the prior."""
    train = rows.where(F.col(label).isNotNull() & ~F.col(test)).select(
        key, F.when(F.col(label) == 1, 1).otherwise(0).alias("pos"), F.when(F.col(label) == 1, 0).otherwise(1).alias("neg"))
    counts = bag.join(train, key).groupBy("token").agg(F.sum(F.col("cnt") * F.col("pos")).alias("pos"), F.sum(F.col("cnt") * F.col("neg")).alias("neg"))
    scored = token_scores(bag, token_weights(counts), key)
    return rows.join(scored, key, "left").crossJoin(F.broadcast(class_prior(train))) \
        .withColumn("logit", F.col("prior") + F.coalesce("score", F.lit(0.0))).drop("score", "prior")


def fusion_bayes(users: DataFrame, bag: DataFrame, key: str, cat_cols: Sequence[str], num_cols: Sequence[str]) -> DataFrame:
    """M6: (key, logit) for every user from token counts, categories and
    numericals, as independent parts: multinomial, categorical and Gaussian.

    ``users`` has one row a key with the columns and pos / neg, the user's
    training labels of either class (0 for users of the test part), so the
    labels' repeated users are weights, not rows. A numerical column without
    training values in one of the classes tells nothing and drops out. The bag is
    read twice (to learn and to score) and held for it."""
    bag = hold(bag)
    counts = bag.join(users.select(key, "pos", "neg").where("pos + neg > 0"), key).groupBy("token").agg(
        F.sum(F.col("cnt") * F.col("pos")).alias("pos"), F.sum(F.col("cnt") * F.col("neg")).alias("neg"))
    out = users.join(token_scores(bag, token_weights(counts), key), key, "left").withColumn("logit", F.coalesce("score", F.lit(0.0))).drop("score")
    for c in cat_cols:
        by = users.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("token")).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where("pos + neg > 0")
        w = token_weights(by).select(F.col("token").alias("_c"), F.col("weight").alias("_w"))
        out = out.join(w, F.col(c) == F.col("_c"), "left").withColumn("logit", F.col("logit") + F.coalesce("_w", F.lit(0.0))).drop("_c", "_w")
    moments = []
    for i, c in enumerate(num_cols):
        x = F.col(c).cast("double")
        for side in ("pos", "neg"):
            n = F.sum(F.when(x.isNotNull(), F.col(side)))
            mean = F.try_divide(F.sum(F.col(side) * x), n)
            moments += [mean.alias(f"_m{side}{i}"), (F.try_divide(F.sum(F.col(side) * x * x), n) - mean * mean + 1e-9).alias(f"_v{side}{i}")]
    out = out.crossJoin(F.broadcast(users.agg(*moments))).crossJoin(F.broadcast(class_prior(users)))  # one row each
    logit = F.col("logit") + F.col("prior")
    for i, c in enumerate(num_cols):
        x = F.col(c).cast("double")
        m1, v1, m0, v0 = (F.col(f"_{k}{side}{i}") for side in ("pos", "neg") for k in ("m", "v"))
        part = (F.log(v0 / v1) - (x - m1) * (x - m1) / v1 + (x - m0) * (x - m0) / v0) / 2
        logit = logit + F.coalesce(part, F.lit(0.0))
    return out.select(key, logit.alias("logit"))


def score_with(df: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.Series]], out_col: str = "score",
               out_type: T.DataType = T.DoubleType()) -> DataFrame:
    """M8: batch scoring hook. ``load`` runs once per task (e.g. loads a
    model from the shared file system); the returned function scores an
    Arrow batch as a pandas frame."""
    schema = T.StructType(list(df.schema.fields) + [T.StructField(out_col, out_type)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fn = load()
        for b in batches:
            b = b.copy()
            b[out_col] = fn(b)
            yield b

    return df.mapInPandas(run, schema)
