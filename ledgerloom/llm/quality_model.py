"""Quality classifier: random Fourier features, ridge scores, isotonic calibration.

Each document is reduced to a few statistics of its whole text. Random cosine
features of the standardised statistics approximate a Gaussian kernel; each
partition of the labelled rows sums its part of the normal equations, the
driver adds the parts (matrices of a fixed size) and solves them. A fold that
the weights have not seen calibrates the scores by isotonic regression.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import common
from ledgerloom.llm.common import staged

BLOCK = 1 << 19
STATISTICS = ["words", "word_bytes", "lower", "upper", "digit", "symbol", "mark", "space", "line", "wide", "same_as_before", "distinct",
              "distinct_pairs", "distinct_eights", "symbol_end", "mark_end", "upper_words", "lone_symbols", "capital_words", "long_words"]
_CLASS = np.full(256, 7, np.int64)  # others: UTF-8 bytes of non-ASCII characters
_CLASS[:128] = 4
_CLASS[ord("a"):ord("z") + 1] = 0
_CLASS[ord("A"):ord("Z") + 1] = 1
_CLASS[ord("0"):ord("9") + 1] = 2
_CLASS[list(b"#*$%&|<>")] = 3
_CLASS[list(common.WHITE)] = 5
_CLASS[ord("\n")] = 6


def statistics(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row of ``STATISTICS`` per text; texts without words have zeros but for their sizes."""
    rows = len(offs) - 1
    size = np.diff(offs)
    kind = _CLASS[data]
    shares = np.bincount(np.repeat(np.arange(rows), size) * 8 + kind, minlength=rows * 8).reshape(rows, 8) / np.maximum(size, 1)[:, None]
    starts, ends, first = common.word_spans(data, offs)
    n = np.diff(first)
    h = common.word_hashes(data, starts, ends)
    row = np.repeat(np.arange(rows), n)
    each = lambda flags: np.bincount(row, flags, rows) / np.maximum(n, 1)
    length = ends - starts
    upper = np.concatenate([[0], np.cumsum(kind == 1)])
    same = np.zeros(len(h))
    same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    last, lead = (kind[ends - 1], kind[starts]) if len(h) else (np.zeros(0), np.zeros(0))
    sums = common.prefix_sums(h)
    distinct = np.zeros((rows, 3))
    for r in range(rows):
        for c, q in enumerate((1, 2, 8)):
            k = n[r] - q + 1
            if k > 0:
                a = np.arange(first[r], first[r] + k)
                distinct[r, c] = len(np.unique(common.span_hash(sums, a, a + q) if q > 1 else h[a])) / (k ** 0.8 if q == 1 else k)
            else:
                distinct[r, c] = 1.0 if n[r] else 0.0
    out = np.column_stack([np.log1p(n), each(length), shares, each(same), distinct, each(last == 3), each(last == 4),
                           each((upper[ends] - upper[starts] == length) & (length > 1)), each((length == 1) & (lead == 3)), each(lead == 1), each(length > 12)])
    return out.astype(np.float64)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offs in common.blocks(batch.column(1), BLOCK):
            x = statistics(data, offs)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), lists], names=["doc_id", "x"])


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    waves: np.ndarray     # statistics x features
    phases: np.ndarray
    weights: np.ndarray
    raw: np.ndarray       # calibration: raw scores, ascending
    calibrated: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.column_stack([np.cos(z @ self.waves + self.phases) * np.sqrt(2 / len(self.phases)), np.ones(len(z))])

    def raw_scores(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw_scores(x), self.raw, self.calibrated), 0.0, 1.0)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.values.slice(column.offsets[0].as_py(), column.offsets[len(column)].as_py() - column.offsets[0].as_py()).to_numpy().reshape(len(column), -1)


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; a null id has remainder 0, so it is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5, F.lit(0))


def fit(measures: DataFrame, labels: DataFrame, *, features: int = 256, ridge: float = 1e-3, width: float = 2.0,
        max_labelled: int = 200_000, seed: int = 11) -> QualityModel:
    """Learn from the labelled rows whose remainder is not 0: remainder 1
    calibrates, the others give the weights. Above ``max_labelled`` labelled
    rows, a sample of about that size by a hash of the id is used. ``width``
    is the kernel's, in units of the root of the number of statistics. Without
    two classes the score is the share of label 1 (0.5 without labels)."""
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y")).where("y is not null") \
        .groupBy("doc_id").agg(F.avg("y").alias("y")).where(remainder(F.col("doc_id")) != 0)
    rows = measures.where("doc_id is not null").dropDuplicates(["doc_id"]).join(y, "doc_id").withColumn("fold", remainder(F.col("doc_id")))
    n = y.count()
    if n > max_labelled:
        rows = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000)) < int(1_000_000 * max_labelled / n))
    rows = staged(rows, "labelled")
    d = len(STATISTICS)
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("y"), *[F.avg(F.get("x", F.lit(i))).alias(f"m{i}") for i in range(d)],
                     *[F.stddev_pop(F.get("x", F.lit(i))).alias(f"s{i}") for i in range(d)]).first()
    draw = np.random.Generator(np.random.PCG64(seed))
    model = QualityModel(
        np.array([stats[f"m{i}"] or 0.0 for i in range(d)]), np.array([stats[f"s{i}"] or 1.0 for i in range(d)]) + 1e-9,
        draw.normal(size=(d, features)) / (width * np.sqrt(d)), draw.uniform(0, 2 * np.pi, features), np.zeros(features + 1),
        np.array([0.0, 1.0]), np.full(2, 0.5 if stats["y"] is None else stats["y"]))
    if stats["y"] is None or stats["y"] in (0.0, 1.0):
        return model

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.zeros((features + 1, features + 1)), np.zeros(features + 1)
        for batch in batches:
            if batch.num_rows:
                z = model.features(_matrix(batch.column(0)))
                a += z.T @ z
                b += z.T @ batch.column(1).to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()), pa.array([b.tobytes()], pa.binary())], names=["a", "b"])

    # the sample is bounded, so its partitions are few; each sends one matrix
    learn = rows.where("fold != 1")
    parts = learn.coalesce(16).select("x", "y").mapInArrow(sums, "a binary, b binary").collect()
    a = sum(np.frombuffer(p["a"]) for p in parts).reshape(features + 1, -1)
    b = sum(np.frombuffer(p["b"]) for p in parts)
    model.weights = np.linalg.solve(a + ridge * max(a[-1, -1], 1.0) / features * np.eye(features + 1), b)

    fold = rows.where("fold = 1")
    if fold.isEmpty():
        fold = learn
    raw = fold.select("x", "y").mapInArrow(_scorer(model.raw_scores, ["y"]), "y double, score double")
    iso = IsotonicRegression(featuresCol="score", labelCol="y").fit(raw)
    model.raw, model.calibrated = np.array(iso.boundaries.toArray()), np.array(iso.predictions.toArray())
    return model


def _scorer(score, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = score(_matrix(batch.column("x"))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(s)], names=[*keep, "score"])
    return run


def measure(docs: DataFrame) -> DataFrame:
    """(doc_id, x): statistics of every whole text, in one narrow pass."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return src.mapInArrow(_measure, "doc_id long, x array<double>")


def score(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, **options) -> DataFrame:
    """Per document: doc_id, held_out, score (0 to 1), predicted.

    Fits on ``labels`` (doc_id, quality) and scores every row of ``docs``. The
    score depends on the text alone. Null and empty texts are scored like any
    other, from zero statistics; repeated rows get equal scores; a label
    repeated for an id counts by its average, a null label not at all; null
    ids are held out; other columns are ignored.
    """
    x = staged(measure(docs), "statistics")
    model = fit(x, labels, **options)
    out = x.mapInArrow(_scorer(model.scores, ["doc_id"]), "doc_id long, score double")
    return out.select("doc_id", (remainder(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
