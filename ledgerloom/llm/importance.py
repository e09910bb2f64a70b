"""Target-distribution importance resampling over hashed n-grams.

An untrained ``Split`` pre-tokenizer of the tokenizers library returns the words
of the ASCII-lowered text with their offsets. A feature is a run of 1 to
``most`` consecutive words joined by one space: a pair of offsets, the begin of
its first and the end of its last word. Its CRC-32 is put together from its
words' (the CRC of a concatenation is a linear map of the first part's,
combined with the second's), so no feature is ever written out as a string.

1. ``hashed`` reads the texts once and writes, for each document, the bucket of
   every feature, and for each task one histogram;
2. the histograms of corpus and target, ``buckets`` rows each, give a gain per
   bucket (logarithm of the ratio of the two smoothed frequencies);
3. a document's weight is the sum of its features' gains; Gumbel noise from
   its id makes the highest scores a draw without replacement;
4. the drawn documents are numbered in order of score through a range shuffle
   of the scores alone, one count a partition and offsets.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import blocks, lowered, staged

#: Words of the lowered text: letters, digits and everything outside ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_PART = np.ones(256, bool)
_PART[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = False
BLOCK = 1 << 22    # bytes of text hashed at a time
STRETCH = 1 << 20  # bytes given to the pre-tokenizer at a time
SHORT = 64         # words up to this many bytes are hashed together, byte place by byte place

# ---------------------------------------------------------------- CRC-32 of many spans


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(0xEDB88320), t >> np.uint32(1))
    return t


_CRC = _crc_table()


def _apply(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """A linear map given by what it makes of each value of each of the four bytes."""
    return table[0][crc & 255] ^ table[1][(crc >> np.uint32(8)) & 255] ^ table[2][(crc >> np.uint32(16)) & 255] ^ table[3][crc >> np.uint32(24)]


def _one_byte() -> np.ndarray:
    """What one more zero byte makes of a CRC."""
    x = np.arange(256, dtype=np.uint32)[None, :] << np.array([0, 8, 16, 24], np.uint32)[:, None]
    return (x >> np.uint32(8)) ^ _CRC[x & 255]


def _doublings() -> list[np.ndarray]:
    """Maps of 1, 2, 4, ... further bytes; 40 of them pass any length."""
    out = [_one_byte()]
    while len(out) < 40:
        out.append(_apply(out[-1], out[-1]))
    return out


_DOUBLE = _doublings()


def crc_shift(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """CRCs moved on by ``n`` bytes each: crc(a + b) is crc_shift(crc(a), len(b)) ^ crc(b)."""
    crc, n = crc.copy(), n.copy()
    for table in _DOUBLE:
        odd = np.flatnonzero(n & 1)
        crc[odd] = _apply(table, crc[odd])
        n >>= 1
        if not n.any():
            break
    return crc


def span_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of data[start:end] for many spans."""
    size = ends - starts
    out = np.zeros(len(starts), np.uint32)
    for i in np.flatnonzero(size > SHORT):
        out[i] = zlib.crc32(data[starts[i]:ends[i]])
    few = np.flatnonzero(size <= SHORT)
    few = few[np.argsort(-size[few], kind="stable")]
    at, left = starts[few], size[few]
    crc = np.full(len(few), 0xFFFFFFFF, np.uint32)
    going = len(few)
    for j in range(int(left[0]) if len(few) else 0):
        going = int(np.searchsorted(-left[:going], -j, "left"))  # the first ones are longer than j
        crc[:going] = (crc[:going] >> np.uint32(8)) ^ _CRC[(crc[:going] ^ data[at[:going] + j]) & 255]
    out[few] = ~crc
    return out


# ---------------------------------------------------------------- words and features

def _splitter():
    from tokenizers import Regex, pre_tokenizers

    return pre_tokenizers.Split(Regex(WORD), "removed", invert=True)


def word_offsets(splitter, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of the words of one lowered UTF-8 text. A long text is given
    to the pre-tokenizer in stretches that end before a separator, so that no
    word is cut; the library's memory is bounded by the stretch and the longest word."""
    starts, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    lo = 0
    while lo < len(data):
        hi = min(lo + STRETCH, len(data))
        while hi < len(data) and _PART[data[hi]]:  # on to the word's end, a stretch of bytes at a time
            more = np.flatnonzero(~_PART[data[hi:hi + STRETCH]])
            hi = hi + int(more[0]) if len(more) else min(hi + STRETCH, len(data))
        piece = data[lo:hi]
        text = piece.tobytes().decode("utf-8")
        found = splitter.pre_tokenize_str(text)
        pairs = np.fromiter((x for _, pair in found for x in pair), np.int64, 2 * len(found))
        if len(text) != len(piece):  # offsets count code points
            place = np.flatnonzero((piece & 0xC0) != 0x80)
            pairs = np.append(place, len(piece))[pairs]
        starts.append(pairs[0::2] + lo)
        ends.append(pairs[1::2] + lo)
        lo = hi
    return np.concatenate(starts), np.concatenate(ends)


def _features(data: np.ndarray, offs: np.ndarray, splitter, most: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words by row, features by row, bucket of each feature, row after row)."""
    data = lowered(data)
    spans = [word_offsets(splitter, data[lo:hi]) for lo, hi in zip(offs, offs[1:])]
    words = np.array([len(s) for s, _ in spans], np.int64)
    starts = np.concatenate([s + o for (s, _), o in zip(spans, offs)])
    ends = np.concatenate([e + o for (_, e), o in zip(spans, offs)])
    size = ends - starts
    single = span_crcs(data, starts, ends)
    spaced = crc_shift(np.full(len(size), zlib.crc32(b" "), np.uint32), size) ^ single  # of a space and the word
    row = np.repeat(np.arange(len(words)), words)
    begin = np.cumsum(words) - words
    left = words[row] - (np.arange(len(size)) - begin[row])  # words from here to the row's end
    counts = [np.maximum(words - k, 0) for k in range(most)]
    total = sum(counts)
    place = np.cumsum(total) - total
    out = np.zeros(int(total.sum()), np.uint16)
    first, window = np.arange(len(size)), single
    for k in range(most):
        if k:  # from k words to k + 1
            fits = left[first] > k
            first, window = first[fits], window[fits]
            window = crc_shift(window, size[first + k] + 1) ^ spaced[first + k]
        r = row[first]
        out[place[r] + first - begin[r]] = window % np.uint32(buckets)
        place = place + counts[k]
    return words, total, out


_HASHED = "doc_id long, n_words long, features binary, histogram array<long>"


def hashed(texts: DataFrame, *, id_col: str = "doc_id", most: int = 3, buckets: int = 10000) -> DataFrame:
    """The features of every whole ``text``, as rows (doc_id, n_words, features)
    with two little-endian bytes a feature, and one row (histogram) a task."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("1 to 65,536 buckets")
    rows = texts.select(F.col("text").cast("string").alias("_text"), F.col(id_col).cast("long").alias("doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, histogram = _splitter(), np.zeros(buckets, np.int64)
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
        names = ["doc_id", "n_words", "features", "histogram"]
        for batch in batches:
            for lo, hi, data, offs in blocks(batch.column(0), BLOCK):
                words, total, out = _features(data, offs, splitter, most, buckets)
                histogram += np.bincount(out, minlength=buckets)
                ends = np.concatenate([[0], np.cumsum(total * 2)])
                raw = out.astype("<u2").tobytes()
                cells = pa.array([raw[a:b] for a, b in zip(ends, ends[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(lo, hi - lo), pa.array(words), cells, pa.nulls(hi - lo, kinds[3])], names=names)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, kinds[0]), pa.nulls(1, kinds[1]), pa.nulls(1, kinds[2]), pa.array([histogram.tolist()], kinds[3])], names=names)

    return staged(rows.mapInArrow(run, _HASHED), "features")


def histogram(features: DataFrame) -> DataFrame:
    """(bucket, n): the tasks' histograms added up."""
    cells = features.where(F.col("histogram").isNotNull()).select(F.posexplode("histogram").alias("bucket", "n"))
    return cells.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = 10000) -> np.ndarray:
    """floor(1000 * ln of the ratio of the smoothed frequencies) by bucket: the
    two histograms of ``buckets`` rows are the only data the driver takes."""
    both = corpus.withColumnRenamed("n", "s").join(target.withColumnRenamed("n", "t"), "bucket", "full").select(
        "bucket", *[F.coalesce(F.col(c), F.lit(0)).cast("double").alias(c) for c in ("s", "t")])
    all_ = Window.partitionBy(F.lit(1))  # ``buckets`` rows
    big_s, big_t = F.sum("s").over(all_) + F.lit(float(buckets)), F.sum("t").over(all_) + F.lit(float(buckets))
    gain = F.floor(F.lit(1000.0) * F.log((F.col("t") + 1.0) * big_s / ((F.col("s") + 1.0) * big_t)))
    out = np.zeros(buckets, np.int64)
    for r in both.select("bucket", gain.cast("long").alias("gain")).collect():
        out[r["bucket"]] = r["gain"]
    return out


def weights(features: DataFrame, gain: np.ndarray, most: int = 3) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the gains of a document's features, added up."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [np.frombuffer(c.as_buffer(), "<u2") for c in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(c) for c in cells], pa.int64()),
                                              pa.array([int(gain[c].sum()) for c in cells], pa.int64())],
                                             names=["doc_id", "n_words", "n_features", "weight"])
    return features.where(F.col("features").isNotNull()).select("doc_id", "n_words", "features").mapInArrow(
        run, "doc_id long, n_words long, n_features long, weight long")


def gumbel(seed: int, id_col: str = "doc_id") -> Column:
    """1000 times standard Gumbel noise, rounded down, from sha256(``seed:id``)."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, *, percent: int = 5, min_words: int = 20, seed: int = 42,
             most: int = 3, buckets: int = 10000, target_id: str = "item_id") -> DataFrame:
    """Draw ``percent`` of the documents with ``min_words`` words or more, likelier
    where their features look like ``target``'s.

    Returns doc_id, n_features, weight, score and rank (1, 2, 3 ... from the
    highest score, ties to the smaller doc_id; null for a document that is not
    drawn), one row per input row. Null and empty texts have no features and
    weight 0. A null id draws its noise from the empty string and comes after
    all ids in a tie; rows alike in score and id are ranked by their number of
    features, and rows alike in that too in some order. An empty target or
    corpus has an empty histogram: the gains are then those of the smoothing
    alone. Other columns are ignored.
    """
    features = hashed(docs, most=most, buckets=buckets)
    wanted = hashed(target, id_col=target_id, most=most, buckets=buckets)
    gain = gains(histogram(features), histogram(wanted), buckets)
    scores = staged(weights(features, gain, most).select(
        "doc_id", "n_words", "n_features", "weight", (F.col("weight") + gumbel(seed)).alias("score")).withColumn("_tie", F.monotonically_increasing_id()), "scores")
    ranked = _ranked(scores.where(F.col("n_words") >= min_words), percent)
    rest = scores.where(F.coalesce(F.col("n_words"), F.lit(0)) < min_words).withColumn("rank", F.lit(None).cast("long"))
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    return ranked.select(columns).unionByName(rest.select(columns))


def _ranked(scores: DataFrame, percent: int) -> DataFrame:
    """``rank`` by descending score for the first ``percent`` of the rows: a range
    shuffle of slim rows, written in order; each partition's rows are numbered
    and one count a partition (its number is ``spark.sql.shuffle.partitions``)
    is added up and sent to all."""
    spark = scores.sparkSession
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("_tie")]
    place = F.monotonically_increasing_id()
    sorted_ = staged(scores.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
                     .withColumn("_part", F.shiftright(place, 33)).withColumn("_row", place.bitwiseAND(F.lit((1 << 33) - 1))), "ranked")
    counts = sorted_.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"),
                            F.floor(F.lit(percent) * F.sum("_n").over(Window.partitionBy(F.lit(1))) / 100).alias("_drawn"))
    rank = F.col("_before") + F.col("_row") + 1
    return sorted_.join(F.broadcast(offsets), "_part").withColumn("rank", F.when(rank <= F.col("_drawn"), rank))


def draw(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn documents themselves, all columns of ``docs``; rows of one
    ``doc_id`` stay together: they are kept if one of them is drawn. Rows
    without an id are not drawn (nothing tells them apart)."""
    drawn = resample(docs, target, **options).where(F.col("rank").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(drawn, docs["doc_id"] == drawn["_drawn"], "left_semi")
