"""Spark ML classifiers on the labelled documents (the fixture with signal)."""
import os

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from ledgerloom.operators import metrics as M
from ledgerloom.operators import models as ML
from ledgerloom.plans import catalog as C

SF = "/root/testdata/sf0.01"


def test_sequence_classifier_auc(spark, scratch):
    d = C.docq_frame(spark, SF)
    cfg = ML.ClassifierConfig(hash_size=1 << 15, max_iter=30)
    model = ML.sequence_classifier(cfg).fit(d.where(~F.col("is_test") & F.col("label").isNotNull()))
    s = ML.scores(model, d, ["user_id", "label", "is_test"]).where(F.col("is_test") & F.col("label").isNotNull())
    auc = M.roc_auc(s.select(F.col("logit").alias("score"), "label")).first().auc
    assert auc >= 0.8
    # Model artefact round trip gives the same scores
    p = os.path.join(scratch, "model")
    model.write().overwrite().save(p)
    again = ML.scores(PipelineModel.load(p), d, ["user_id"]).orderBy("user_id").collect()
    first = ML.scores(model, d, ["user_id"]).orderBy("user_id").collect()
    assert [round(r.probability, 12) for r in again] == [round(r.probability, 12) for r in first]


def test_count_classifier_scores_every_document(spark):
    """The closed-form classifier beside the regression: as good on its test
    part, and a logit for documents without a label too."""
    s = C.docq_scores(spark, SF).cache()
    assert s.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert s.where("label is null").count() > 0 and s.where("logit is null").count() == 0
    test = s.where(F.col("is_test") & F.col("label").isNotNull())
    assert M.roc_auc(test.select(F.col("logit").alias("score"), "label")).first().auc >= 0.8


def test_batch_scoring_hook(spark):
    df = spark.createDataFrame([(1, 4500.0), (2, 0.0)], "user_id long, num_acctbal double")
    out = {r.user_id: r.score for r in ML.score_with(df, C._acctbal_scorer).collect()}
    assert abs(out[1] - 0.5) < 1e-12 and out[2] < 0.02
