"""Byte-pair vocabulary learned and applied as Spark jobs.

Training follows the usual greedy rule: start from the special tokens and
then every character (code-point order); repeatedly merge the adjacent pair
with the highest corpus count, ties going to the smallest (left id, right
id); a merged string that already exists keeps its id; stop at
``vocab_size`` or when no pair is left.

The corpus is reduced to a histogram of distinct words (``word_histogram``:
explode + map-side combined count), the only step that touches the raw text;
``bpe_train`` learns the merges from it, ``encode_texts`` applies them.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.encode import WORD_PATTERN
from ledgerloom.operators.bpe_train import learn_merges
from ledgerloom.session import drop_written, written


def special_split_pattern(specials: Sequence[str]) -> str:
    """Special tokens whole, longest first; word and punctuation runs end
    where the next special begins (``!<EOT>`` is ``!`` and ``<EOT>``)."""
    if not specials:
        return WORD_PATTERN
    alts = "|".join(re.escape(s) for s in sorted(specials, key=len, reverse=True))
    return f"(?U)(?:{alts})|(?:(?!{alts})\\w)+|(?:(?!{alts})[^\\w\\s])+"


def pretokenize(text, specials: Sequence[str] = ()) -> Column:
    """Words of a text column (specials kept whole when given)."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(special_split_pattern(specials)), 0)


def word_histogram(texts: DataFrame, text_col: str, specials: Sequence[str] = (),
                   protect_specials: bool = False) -> DataFrame:
    """B2: (word, cnt) over the corpus. With ``protect_specials`` the special
    tokens are split off whole and left out of the histogram (they are
    atomic); the reference trains on unprotected text, hence the default."""
    pat = specials if protect_specials else ()
    words = texts.select(F.explode(pretokenize(text_col, pat)).alias("word"))
    if protect_specials and specials:
        words = words.where(~F.col("word").isin(*specials))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("cnt"))


def chunked_word_histogram(chunks: DataFrame, key: str, text_col: str) -> DataFrame:
    """B2 over texts stored as consecutive chunks (``key``, ``chunk``, text)
    that were joined without a separator: equal to the histogram of each
    key's whole text.

    Words inside a chunk are counted where they are. A chunk's first and last
    run may go on in its neighbours, through any number of chunks that are a
    single run; such runs are numbered along the key (a new run begins where
    the previous chunk's end does not touch, or is of the other kind) and put
    together by (key, run). Only the edge runs are shuffled, never a text."""
    kind = lambda c: F.when(c.rlike(r"^(?U)\w+$"), F.lit(1)).otherwise(F.lit(2))
    w = chunks.select(key, "chunk", F.coalesce(F.col(text_col), F.lit("")).alias("_t"), pretokenize(text_col).alias("_w")) \
              .where(F.length("_t") > 0).withColumn("_n", F.size("_w"))
    inner = w.select(F.explode(F.slice("_w", 2, F.greatest(F.col("_n") - 2, F.lit(0)))).alias("word"))
    first, last = F.try_element_at("_w", F.lit(1)), F.try_element_at("_w", F.lit(-1))
    head = F.struct(F.lit(0).alias("side"), first.alias("run"), F.col("_t").startswith(first).alias("open_l"),
                    ((F.col("_n") == 1) & F.col("_t").endswith(first)).alias("open_r"))
    tail = F.struct(F.lit(1).alias("side"), last.alias("run"), F.lit(False).alias("open_l"), F.col("_t").endswith(last).alias("open_r"))
    blank = F.struct(F.lit(0).alias("side"), F.lit(None).cast("string").alias("run"), F.lit(False).alias("open_l"), F.lit(False).alias("open_r"))
    edges = w.select(key, "chunk", F.explode(F.when(F.col("_n") == 0, F.array(blank)).when(F.col("_n") == 1, F.array(head))
                                             .otherwise(F.array(head, tail))).alias("e")).select(key, "chunk", "e.*")
    order = Window.partitionBy(key).orderBy("chunk", "side")
    goes_on = F.col("open_l") & F.lag("open_r", 1, False).over(order) & (kind(F.col("run")) == kind(F.lag("run").over(order)))
    runs = edges.withColumn("_new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)) \
                .withColumn("_run", F.sum("_new").over(order)).where(F.col("run").isNotNull())
    whole = runs.groupBy(key, "_run").agg(F.array_sort(F.collect_list(F.struct("chunk", "side", "run"))).alias("_p")) \
                .select(F.array_join(F.transform("_p", lambda x: x["run"]), "").alias("word"))
    return inner.unionByName(whole).groupBy("word").agg(F.count(F.lit(1)).alias("cnt"))


def char_symbols(word: str = "word") -> Column:
    """A word as its list of characters (code points, not UTF-16 units)."""
    return F.regexp_extract_all(F.col(word), F.lit("(?s)."), 0)


def pair_counts(words: DataFrame, sym: str = "sym", cnt: str = "cnt") -> DataFrame:
    """Weighted counts of adjacent symbol pairs (overlaps count: ``aaa``
    holds the pair ``aa`` twice)."""
    n = F.size(sym)
    pairs = F.arrays_zip(F.slice(sym, 1, n - 1).alias("l"), F.slice(sym, 2, n - 1).alias("r"))
    ex = words.where(n > 1).select(F.col(cnt).alias("_c"), F.explode(pairs).alias("_p"))
    return ex.groupBy(F.col("_p.l").alias("left"), F.col("_p.r").alias("right")).agg(
        F.sum("_c").cast("bigint").alias("cnt"))


@dataclass
class BpeModel:
    """A trained vocabulary: ``vocab`` (token, id, is_special) and ``merges``
    (rank, left, right, merged) as DataFrames, plus the driver-side lists
    (bounded by ``vocab_size``) used to build them."""

    tokens: list[str]
    specials: list[str]
    merges_list: list[tuple[str, str, str]]
    rounds: int = 0
    vocab: DataFrame | None = field(default=None, repr=False)
    merges: DataFrame | None = field(default=None, repr=False)

    def token_to_id(self) -> dict[str, int]:
        return {t: i for i, t in enumerate(self.tokens)}


def train_bpe(spark: SparkSession, histogram: DataFrame, vocab_size: int, specials: Sequence[str] = (),
              min_frequency: int = 0, stats: dict | None = None) -> BpeModel:
    """Learn merges from a (word, cnt) histogram (see ``bpe_train``)."""
    tokens: list[str] = []
    token_id: dict[str, int] = {}
    for s in specials:
        if s not in token_id:
            token_id[s] = len(tokens)
            tokens.append(s)
    path, hist = written(histogram.where(F.col("word").isNotNull() & (F.length("word") > 0)), "histogram")
    try:
        chars = hist.select(F.explode(char_symbols("word")).alias("ch")).distinct()
        # the alphabet is bounded by the number of distinct characters
        for ch in sorted(r["ch"] for r in chars.collect()):
            if ch not in token_id:
                token_id[ch] = len(tokens)
                tokens.append(ch)
        counted = {} if stats is None else stats
        merges = learn_merges(spark, hist, tokens, token_id, vocab_size, min_frequency=min_frequency, stats=counted)
    finally:
        drop_written(spark, path)
    return attach_frames(spark, BpeModel(tokens=tokens, specials=list(specials), merges_list=merges, rounds=counted["rounds"]))


def attach_frames(spark: SparkSession, model: BpeModel) -> BpeModel:
    """Vocabulary and merge DataFrames of a model (sizes bounded by vocab_size)."""
    sp = set(model.specials)
    model.vocab = spark.createDataFrame(
        [(t, i, t in sp) for i, t in enumerate(model.tokens)], "token string, id int, is_special boolean")
    model.merges = spark.createDataFrame(
        [(k, l, r, m) for k, (l, r, m) in enumerate(model.merges_list)],
        "rank int, left string, right string, merged string")
    return model


def load_bpe(spark: SparkSession, vocab: DataFrame, merges: DataFrame) -> BpeModel:
    """A usable model from the saved tables (vocab: token, id, is_special;
    merges: rank, left, right, merged), both bounded by the vocabulary size."""
    rows = vocab.orderBy("id").collect()
    if [r["id"] for r in rows] != list(range(len(rows))):
        raise ValueError("the ids of a saved vocabulary must be 0, 1, 2, ...")
    ranked = [(r["left"], r["right"], r["merged"]) for r in merges.orderBy("rank").collect()]
    return attach_frames(spark, BpeModel([r["token"] for r in rows], [r["token"] for r in rows if r["is_special"]], ranked))


# ---------------------------------------------------------------------------
# Encoding (B6, B8)

class WordEncoder:
    """Merges by rank (lowest first, leftmost among equals) over one word,
    with a heap of candidate pairs; answers of a bounded number of words are
    kept. The tables are bounded by the vocabulary and travel with the task."""

    def __init__(self, tokens: Sequence[str], merges: Sequence[tuple[str, str, str]], specials: Sequence[str], unk: str | None, keep: int = 100_000):
        self.ids = {t: i for i, t in enumerate(tokens)}
        self.ranks = {(left, right): k for k, (left, right, _) in enumerate(merges)}
        self.specials, self.unk, self.keep = set(specials), unk, keep
        self.known: dict[str, tuple[list[str], list[int]]] = {}

    def pieces(self, word: str) -> list[str]:
        sym: list[str | None] = []
        fixed = set()  # places of unknown characters: nothing merges with them
        for ch in word:
            if ch in self.ids:
                sym.append(ch)
            elif self.unk is not None:
                fixed.add(len(sym))
                sym.append(self.unk)
        nxt, prv = list(range(1, len(sym) + 1)), list(range(-1, len(sym) - 1))
        heap: list[tuple[int, int, str, str]] = []

        def push(i: int) -> None:
            if i >= 0 and nxt[i] < len(sym) and i not in fixed and nxt[i] not in fixed:
                rank = self.ranks.get((sym[i], sym[nxt[i]]))
                if rank is not None:
                    heapq.heappush(heap, (rank, i, sym[i], sym[nxt[i]]))

        for i in range(len(sym) - 1):
            push(i)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = nxt[i]
            if sym[i] != left or j >= len(sym) or sym[j] != right:
                continue
            sym[i], sym[j], nxt[i] = left + right, None, nxt[j]
            if nxt[i] < len(sym):
                prv[nxt[i]] = i
            push(i)
            push(prv[i])
        return [s for s in sym if s is not None]

    def __call__(self, word: str) -> tuple[list[str], list[int]]:
        if word in self.specials:
            return [word], [self.ids[word]]
        got = self.known.get(word)
        if got is None:
            p = self.pieces(word)
            got = (p, [self.ids[t] for t in p])
            if len(self.known) >= self.keep:
                self.known.clear()
            self.known[word] = got
        return got


def encode_texts(texts: DataFrame, key_cols: Sequence[str], text_col: str, model: BpeModel,
                 specials: Sequence[str] = (), unk: str | None = None) -> DataFrame:
    """B6 on a text column: pre-tokenize (specials whole) on the JVM side, then
    encode the words of each row. Returns key_cols + (pieces, ids), one row
    per input row; a null text has no pieces. Narrow: no explode, no join on
    frequent words, no regroup. Characters outside the vocabulary are dropped
    (``unk`` None) or become one ``unk`` each."""
    keys = list(key_cols)
    rows = texts.select(*keys, pretokenize(text_col, specials).alias("_w"))
    tokens, merges, whole = list(model.tokens), list(model.merges_list), [s for s in specials if s in set(model.tokens)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(tokens, merges, whole, unk)
        for b in batches:
            pieces, ids = [], []
            for words in b.column(len(keys)).to_pylist():
                got = [encoder(w) for w in words]
                pieces.append([t for p, _ in got for t in p])
                ids.append([i for _, n in got for i in n])
            yield pa.RecordBatch.from_arrays([*b.columns[:len(keys)], pa.array(pieces, pa.list_(pa.string())), pa.array(ids, pa.list_(pa.int32()))],
                                             names=[*keys, "pieces", "ids"])

    schema = T.StructType([*rows.schema.fields[:len(keys)], T.StructField("pieces", T.ArrayType(T.StringType())),
                           T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return rows.mapInArrow(run, schema)
