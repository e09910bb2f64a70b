"""Removal of word passages that earlier documents hold, by recompression.

Recompression replaces, level by level, runs of one symbol and pairs of
neighbouring symbols by new symbols. Here a symbol's name is a fingerprint of
what it replaces, so the naming is global without any exchange, and whether
two neighbours are joined depends on these two alone (equal, or the left one's
name has side bit 0 and the right one's 1). Each symbol carries the interval
of words its parse depends on. A symbol whose interval lies inside a window is
an interior symbol of the window: it appears at the same place in every other
occurrence of the window, whatever surrounds that.

Each window of ``width`` words is named after one interior symbol of the
highest level that has any (the least name; words are level 0, so there
always is one). Consecutive windows with one symbol form a segment:

1. documents become segments (symbol, fingerprint of the segment's words);
2. a symbol in one document only cannot be a repeat: only shared ones stay.
   Where all segments of a symbol are equal, all their windows are verified
   at once;
3. else one copy of each distinct segment is cut into its windows, which
   are compared by fingerprint under the symbol;
4. documents lose the words covered by windows whose least document is
   smaller than they.

Copies are combined before every shuffle (least document by symbol, segment
and window), so a passage in a third of all documents is one row a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import common
from ledgerloom.llm.common import LAST, mix, prefix_sums, span_hash, staged

BLOCK = 1 << 18
CHUNK = 1 << 18    # words of one text that are parsed at a time
LEVELS = 5         # at level 5 a symbol spans about 4 words and depends on about 23
MOST_SYMBOL = 64   # words a symbol may span
FAR = 1 << 60
SEGMENT = "doc long, key long, at int, n int, symbol long, segment long"


def levels(words: np.ndarray, offs: np.ndarray, count: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per level: names, and first and end word of the interval each depends
    on, of the symbols whose interval lies inside their row."""
    n = len(words)
    name, start, end = mix(words), np.arange(n), np.arange(1, n + 1)
    low, high = start.copy(), end.copy()
    border = np.zeros(n + 1, bool)
    border[offs] = True
    out = [(name, low, high)]
    for level in range(1, count + 1):
        if not n:
            out.append(out[0])
            continue
        side = mix(name + np.uint64(level)) >> np.uint64(63)
        joined = ((name[1:] == name[:-1]) | ((side[:-1] == 0) & (side[1:] == 1))) & ~border[start[1:]]
        first = np.flatnonzero(np.concatenate([[True], ~joined]))
        last = np.append(first[1:], len(name)) - 1
        wide = (end[last] - start[first] > MOST_SYMBOL) & (last > first)
        lost = np.zeros(len(name), bool)
        if wide.any():  # too long a run: its symbols stay as they are, and depend on all of it
            lost = np.repeat(wide, last - first + 1)
            first = np.flatnonzero(np.concatenate([[True], ~joined | lost[1:]]) | lost)
            last = np.append(first[1:], len(name)) - 1
        before, after = np.maximum(first - 1, 0), np.minimum(last + 1, len(name) - 1)
        new_low = np.where(border[start[first]], -1, low[before])
        new_high = np.where(border[end[last]], FAR, high[after])
        name = span_hash(prefix_sums(name), first, last + 1)
        out_of = lost[first] | (new_low < 0) | (new_high >= FAR)
        start, end = start[first], end[last]
        low, high = np.where(out_of, -1, new_low), np.where(out_of, FAR, new_high)
        inside = ~out_of
        out.append((name[inside], low[inside], high[inside]))
    return out


def least_in(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Index of the least value in each non-empty range, leftmost among equals."""
    table = [np.arange(len(values))]
    span = int((hi - lo).max(initial=1))
    while 2 << (len(table) - 1) <= span:
        t, half = table[-1], 1 << (len(table) - 1)
        a, b = t[:-half], t[half:]
        table.append(np.where(values[b] < values[a], b, a))
    k = np.log2(np.maximum(hi - lo, 1)).astype(np.int64)
    out = np.zeros(len(lo), np.int64)
    for j, t in enumerate(table):
        m = np.flatnonzero(k == j)
        a, b = t[lo[m]], t[hi[m] - (1 << j)]
        out[m] = np.where(values[b] < values[a], b, a)
    return out


def segments(words: np.ndarray, offs: np.ndarray, width: int, count: int = LEVELS) -> tuple[np.ndarray, ...]:
    """(first window, number of windows, symbol, segment fingerprint) of all
    rows' segments; places are those in ``words``."""
    n = np.diff(offs)
    windows = np.maximum(n - width + 1, 0)
    at = np.repeat(offs[:-1] - np.concatenate([[0], np.cumsum(windows)[:-1]]), windows) + np.arange(windows.sum())
    sums = prefix_sums(words)
    anchor, symbol = np.full(len(at), -1, np.int64), np.zeros(len(at), np.uint64)
    open_ = np.arange(len(at))
    parsed = levels(words, offs, count)
    for level in range(count, -1, -1):
        name, low, high = parsed[level]
        if not len(open_):
            break
        lo = np.searchsorted(low, at[open_])
        hi = np.searchsorted(high, at[open_] + width, "right")
        have = hi > lo
        if not have.any():
            continue
        # the name with all it depends on: equal symbols have equal surroundings
        full = mix(span_hash(sums, low, high) + name + np.uint64(level))
        best = least_in(full, lo[have], hi[have])
        mine = open_[have]
        anchor[mine] = low[best] * (count + 1) + level
        symbol[mine] = full[best]
        open_ = open_[~have]
    if not len(at):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1) | (symbol[1:] != symbol[:-1])])
    first = np.flatnonzero(new)
    many = np.diff(np.append(first, len(at)))
    return at[first], many, symbol[first], span_hash(sums, at[first], at[first] + many + width - 1)


def _words(data: np.ndarray, offs: np.ndarray):
    starts, ends, first = common.word_spans(data, offs)
    return common.word_hashes(data, starts, ends), starts, ends, first


def _segmenter(width: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for lo, hi, data, offs in common.blocks(batch.column(2), BLOCK):
                w, _, _, first = _words(data, offs)
                # a long text is parsed in chunks that overlap by a window less a word: no window is lost
                step = max(CHUNK, width)
                for a in range(0, max(len(w), 1) if hi - lo == 1 else 1, step):
                    part, at0 = (w[a:a + step + width - 1], np.array([0, len(w[a:a + step + width - 1])])) if hi - lo == 1 else (w, first)
                    at, n, symbol, segment = segments(part, at0, width)
                    row = np.searchsorted(at0, at, "right") - 1 if hi - lo > 1 else np.zeros(len(at), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[lo + row]), pa.array(keys[lo + row]), pa.array((at - at0[row] + a).astype(np.int32)),
                                                      pa.array(n.astype(np.int32)), pa.array(symbol.view(np.int64)), pa.array(segment.view(np.int64))],
                                                     names=["doc", "key", "at", "n", "symbol", "segment"])
    return cut


def _windower(width: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, cells = batch.column(1), batch.column(1).to_pylist()
            del lists
            for lo, hi, data, offs in common.blocks(batch.column(0), BLOCK):
                w, _, _, first = _words(data, offs)
                sums = prefix_sums(w)
                symbol, segment, off, least, at = [], [], [], [], []
                for r in range(lo, hi):
                    for c in cells[r]:
                        k = np.arange(c["n"])
                        at.append(first[r - lo] + c["at"] + k)
                        off.append(k)
                        symbol.append(np.full(c["n"], c["symbol"], np.int64))
                        segment.append(np.full(c["n"], c["segment"], np.int64))
                        least.append(np.full(c["n"], c["least"], np.int64))
                if at:
                    a = np.concatenate(at)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(symbol)), pa.array(np.concatenate(segment)), pa.array(np.concatenate(off).astype(np.int32)),
                                                      pa.array(span_hash(sums, a, a + width).view(np.int64)), pa.array(np.concatenate(least))],
                                                     names=["symbol", "segment", "off", "window", "least"])
    return cut


def _remover(digest: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, spans = batch.column(0), batch.column(2).to_pylist()
            total, gone, kept = [], [], []
            for lo, hi, data, offs in common.blocks(batch.column(1), BLOCK):
                starts, ends, first = common.word_spans(data, offs)
                raw = data.tobytes()
                for r in range(lo, hi):
                    a, b = first[r - lo], first[r - lo + 1]
                    out = np.zeros(b - a + 1, np.int32)
                    for s in spans[r] or ():
                        out[s["a"]] += 1
                        out[s["b"]] -= 1
                    stay = np.flatnonzero(np.cumsum(out[:-1]) == 0) + a
                    text = b" ".join([raw[x:y] for x, y in zip(starts[stay].tolist(), ends[stay].tolist())])
                    total.append(int(b - a))
                    gone.append(int(b - a - len(stay)))
                    kept.append(hashlib.sha256(text).hexdigest() if digest else text.decode("utf-8"))
            yield pa.RecordBatch.from_arrays([ids, pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())],
                                             names=["doc_id", "n_words", "n_removed", "kept"])
    return cut


def repeated_spans(src: DataFrame, width: int) -> DataFrame:
    """(doc, key, spans of words to remove) of the documents (doc, key, text)
    that lose any."""
    seg = staged(src.select("doc", "key", "text").mapInArrow(_segmenter(width), SEGMENT), "segments")
    shared = seg.groupBy("symbol").agg(F.min("doc").alias("d0"), F.max("doc").alias("d1"), F.min("segment").alias("s0"), F.max("segment").alias("s1")) \
        .where("d0 != d1").select("symbol", "d0", (F.col("s0") != F.col("s1")).alias("mixed"))
    # written, so that the join has a shuffle of its own and a very frequent symbol's rows can be split
    seg = staged(seg.join(staged(shared, "symbols"), "symbol"), "shared")

    first = seg.where("mixed").groupBy("symbol", "segment").agg(F.min(F.struct("doc", "key", "at", "n")).alias("of"))
    todo = first.select("of.doc", "of.key", F.struct("of.at", "of.n", "symbol", "segment", F.col("of.doc").alias("least")).alias("cell")) \
        .groupBy("doc", "key").agg(F.collect_list("cell").alias("cells"))
    one = src.join(todo, ["doc", "key"]).dropDuplicates(["doc", "key"]).select("text", "cells")
    windows = staged(one.mapInArrow(_windower(width), "symbol long, segment long, off int, window long, least long"), "windows")
    least = windows.groupBy("symbol", "window").agg(F.min("least").alias("d0"))
    per = windows.join(least, ["symbol", "window"]).groupBy("symbol", "segment").agg(F.array_sort(F.collect_list(F.struct("off", "d0"))).alias("mins"))

    per = staged(per, "mins")
    whole = seg.where("not mixed and d0 < doc").select("doc", "key", F.col("at").alias("a"), (F.col("at") + F.col("n") + (width - 1)).alias("b"))
    some = seg.where("mixed").select("doc", "key", "at", "symbol", "segment").join(per, ["symbol", "segment"]) \
        .select("doc", "key", "at", F.explode("mins").alias("m")).where("m.d0 < doc") \
        .groupBy("doc", "key", "at").agg(F.collect_list("m.off").alias("offs")) \
        .select("doc", "key", "at", F.explode(_joined("offs")).alias("r")) \
        .select("doc", "key", (F.col("at") + F.col("r.x")).alias("a"), (F.col("at") + F.col("r.y") + width).alias("b"))
    return whole.unionByName(some).groupBy("doc", "key").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def _joined(offs: str):
    """Offsets of one segment (some tens) as maximal runs (first, last)."""
    return F.expr(f"""aggregate(array_sort({offs}), cast(array() as array<struct<x:int,y:int>>), (r, o) ->
        if(size(r) > 0 and element_at(r, -1).y = o - 1,
           concat(slice(r, 1, size(r) - 1), array(named_struct('x', element_at(r, -1).x, 'y', o))),
           concat(r, array(named_struct('x', o, 'y', o)))))""")


def remove_repeats(docs: DataFrame, *, width: int = 50, digest: bool = False) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept (the words that stay,
    joined by one space; with ``digest`` kept_sha256).

    A word goes if a window of ``width`` words of its own document covers it
    that also starts in a document with a smaller id. One row per input row.
    Null, empty and short texts lose nothing; rows with equal ids are one
    document for this rule; a null id counts as larger than any other; other
    columns are ignored.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"),
                      F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    spans = staged(repeated_spans(src, width), "spans")
    out = src.join(spans, ["doc", "key"], "left").select("doc_id", "text", "spans") \
        .mapInArrow(_remover(digest), "doc_id long, n_words long, n_removed long, kept string")
    return out.withColumnRenamed("kept", "kept_sha256") if digest else out
