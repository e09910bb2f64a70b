"""The stream encoder equals the batch encoder; pipelines run end to end."""
import os
import shutil

from pyspark.sql import functions as F

from ledgerloom.plans import pipelines as P
from ledgerloom.sources import tables as T
from ledgerloom.streaming import encode_stream as ST

SF = "/root/testdata/sf0.001"


def test_stream_matches_batch(spark, scratch):
    src = os.path.join(scratch, "in")
    os.makedirs(src)
    shutil.copy(os.path.join(SF, "events.parquet"), os.path.join(src, "part-0.parquet"))
    q = ST.start_token_sink(ST.encode_events(ST.read_event_stream(spark, src)), os.path.join(scratch, "out"),
                            os.path.join(scratch, "ckpt"))
    q.awaitTermination(120)
    got = spark.read.parquet(os.path.join(scratch, "out"))
    want = ST.encode_events(spark.read.parquet(os.path.join(SF, "events.parquet")))
    assert got.count() == want.count()
    assert got.exceptAll(want).count() == 0


def test_pretrain_and_finetune_pipelines(spark):
    tx = T.transactions_from_events(spark, SF)
    cfg = P.PretrainConfig(vocab_size=120, context_length=64, batch_size=8)
    model, seqs, batches = P.pretrain_data(spark, tx, cfg)
    ids = model.token_to_id()
    rows = batches.collect()
    assert rows and all(len(r.x) == len(r.y) == r.batch_len <= 64 for r in rows)
    first = seqs.where(F.col("chunk") == 0).first()
    assert ids["[SEP]"] in first.tokens
    ft = P.finetune_data(T.label_rows(spark, SF), T.customer_features(spark, SF), seqs, 64, pad=ids["[PAD]"])
    out = ft.collect()
    assert out and all(len(r.tokens) >= 1 for r in out)
    assert abs(sum(r.is_test for r in out) - 0.2 * len(out)) < 1
    pred, acc = P.predict_next(seqs, 3)
    assert acc.count() == 3
