"""Removal of byte passages that occur more than once, by suffix arrays.

A suffix array of all texts fits no task, so windows are first dealt out by
content. Each window of ``width`` bytes is named after the least fingerprint
of its ``part``-byte pieces (a symbol); equal windows get equal symbols.
Consecutive windows with one symbol form a segment:

1. texts become segments (symbol, fingerprint of the segment's bytes), which
   are counted; symbols that occur once hold no repeat, and where all
   segments of a symbol are equal, all their windows are repeats;
2. one copy of every other segment is sent to the task of its symbol. There,
   suffix arrays are built by ``suffix_groups`` over the parts that any other
   segment of the symbol can share, and neighbours that agree on ``width``
   bytes are repeats. Symbols with very many segments are not gathered: their
   windows are compared by fingerprint through a shuffle;
3. texts lose the bytes of all repeated windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import common
from ledgerloom.llm.common import LAST, mix, span_hash, staged
from ledgerloom.llm.suffix_groups import suffix_array

BLOCK = 1 << 19   # bytes worked on at a time; places must fit 20 bits
STEP = 8          # bytes by which shared surroundings are measured
BATCH = 1 << 15   # bytes of one suffix array, but for a single larger symbol
MANY = 2000       # distinct segments of a symbol from which it is not gathered
SEGMENT = "doc long, key long, at long, n int, anchor int, symbol long, segment long"


def byte_segments(data: np.ndarray, offs: np.ndarray, width: int, part: int) -> tuple[np.ndarray, ...]:
    """(first window, windows, place of the piece in the first window, symbol,
    segment fingerprint) of all rows' segments."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < width:
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    sums = common.byte_sums(data)
    pieces, span, windows = n - part + 1, width - part + 1, n - width + 1
    h = mix((sums[part:] - sums[:-part]) * common.powers(pieces, "down"))
    low = np.uint64((1 << 20) - 1)
    cells = np.full(-(-pieces // span) * span, ~np.uint64(0))
    cells[:pieces] = (h & ~low) | np.arange(pieces, dtype=np.uint64)
    # least of every `span` neighbours: from both ends of fixed stretches
    grid = cells.reshape(-1, span)
    right = np.minimum.accumulate(grid, axis=1).reshape(-1)
    left = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    piece = (np.minimum(left[:windows], right[span - 1:span - 1 + windows]) & low).astype(np.int64)
    size = np.maximum(np.diff(offs) - width + 1, 0)
    at = np.repeat(offs[:-1] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    if not len(at):
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    own = piece[at]
    first = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)]))
    many = np.diff(np.append(first, len(at)))
    start = at[first]
    return start, many, own[first] - start, h[own[first]], span_hash(sums, start, start + many + width - 1)


def _segmenter(width: int, part: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for lo, hi, data, offs in common.blocks(batch.column(2), BLOCK):
                # a long text is cut into stretches that overlap by a window less a byte
                single = hi - lo == 1
                for a in range(0, max(len(data) - width + 1, 1) if single else 1, BLOCK):
                    part_of = data[a:a + BLOCK + width - 1] if single else data
                    where = np.array([0, len(part_of)]) if single else offs
                    at, n, anchor, symbol, segment = byte_segments(part_of, where, width, part)
                    row = np.zeros(len(at), np.int64) if single else np.searchsorted(where, at, "right") - 1
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[lo + row]), pa.array(keys[lo + row]), pa.array(at - where[row] + a), pa.array(n.astype(np.int32)),
                         pa.array(anchor.astype(np.int32)), pa.array(symbol.view(np.int64)), pa.array(segment.view(np.int64))],
                        names=["doc", "key", "at", "n", "anchor", "symbol", "segment"])
    return cut


def _copier(width: int):
    """The bytes of the asked-for segments of each text."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = common.text_bytes(batch.column(0))
            raw = data.tobytes()
            for lo in range(0, batch.num_rows, 64):
                cells = [(c, int(offs[lo + i])) for i, row in enumerate(batch.column(1).slice(lo, 64).to_pylist()) for c in row]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([c[k] for c, _ in cells], t) for k, t in (("symbol", pa.int64()), ("segment", pa.int64()), ("anchor", pa.int32()), ("many", pa.bool_()))]
                    + [pa.array([raw[o + c["at"]:o + c["at"] + c["n"] + width - 1] for c, o in cells], pa.binary())],
                    names=["symbol", "segment", "anchor", "many", "bytes"])
    return cut


def _shared_reach(sums: np.ndarray, fixed: np.ndarray, room: np.ndarray, side: int, part: int, most: int) -> np.ndarray:
    """For pieces at ``fixed``, how far to one side (-1, 1) their surroundings
    can agree with those of another row: an upper bound, at most ``room``."""
    reach = np.zeros(len(fixed), np.int64)
    for far in range(0, most + 1, STEP):
        on = np.flatnonzero(room >= far)
        a, b = (fixed[on] - far, fixed[on] + part) if side < 0 else (fixed[on], fixed[on] + part + far)
        _, back, count = np.unique(span_hash(sums, a, b), return_inverse=True, return_counts=True)
        on = on[count[back] > 1]
        if not len(on):
            break
        reach[on] = far + STEP - 1
    return np.minimum(reach, room)


def repeated_windows(texts: list[bytes], anchors: np.ndarray, width: int, part: int) -> list[np.ndarray]:
    """Per segment, the windows (by place) that another of the segments holds
    too. Segments of one symbol agree in ``part`` bytes at ``anchors``."""
    size = np.array([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts), np.uint8)
    begin = np.cumsum(size) - size
    sums = common.byte_sums(data)
    fixed, after = begin + anchors, size - anchors - part
    left = _shared_reach(sums, fixed, anchors, -1, part, width - part)
    right = _shared_reach(sums, fixed, after, 1, part, width - part)
    lo, hi = fixed - left, fixed + part + right
    some = np.flatnonzero(hi - lo >= width)
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(texts)
    if len(some) < 2:
        return out
    up = len(some) + 1
    symbols: list[int] = []
    where = []  # place in the data of each symbol; -1 where no window starts
    for k, r in enumerate(some, 1):
        symbols += (data[lo[r]:hi[r]].astype(np.int64) + up).tolist()
        symbols.append(k)
        where.append(np.append(np.where(np.arange(lo[r], hi[r]) + width <= hi[r], np.arange(lo[r], hi[r]), -1), -1))
    symbols.append(0)
    order = np.concatenate([*where, [-1]])[np.array(suffix_array(symbols))]
    order = order[order >= 0]
    h = span_hash(sums, order, order + width)
    same = h[1:] == h[:-1]
    hit = np.zeros(len(order), bool)
    hit[1:] |= same
    hit[:-1] |= same
    found = np.sort(order[hit])
    row = np.searchsorted(begin, found, "right") - 1
    for r in np.unique(row):
        out[r] = found[row == r] - begin[r]
    return out


def runs(places: np.ndarray) -> list[dict]:
    cut = np.flatnonzero(np.diff(places) != 1) + 1
    return [{"x": int(p[0]), "y": int(p[-1])} for p in np.split(places, cut)] if len(places) else []


def _sorter(width: int, part: int):
    """Rows sorted by symbol: whole symbols are gathered up to ``BATCH`` bytes."""
    spans = pa.list_(pa.struct([("x", pa.int32()), ("y", pa.int32())]))

    def solve(held: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        found = repeated_windows([t for *_, t in held], np.array([a for _, _, a, _ in held]), width, part)
        rows = [(s, g, runs(f)) for (s, g, _, _), f in zip(held, found) if len(f)]
        cols = list(zip(*rows)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.int64(), spans))], names=["symbol", "segment", "runs"])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if size >= BATCH and row[0] != held[-1][0]:
                    yield solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield solve(held)
    return sort


def _windower(width: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            symbol, segment = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for lo, hi, data, offs in common.blocks(batch.column(2), BLOCK):
                sums, n = common.byte_sums(data), np.maximum(np.diff(offs) - width + 1, 0)
                row = np.repeat(np.arange(hi - lo), n)
                off = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                at = offs[row] + off
                yield pa.RecordBatch.from_arrays([pa.array(symbol[lo + row]), pa.array(segment[lo + row]), pa.array(off.astype(np.int32)),
                                                  pa.array(span_hash(sums, at, at + width).view(np.int64))], names=["symbol", "segment", "off", "window"])
    return cut


def _remover(digest: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = common.text_bytes(batch.column(1))
            raw = memoryview(data.tobytes())
            total, gone, many, kept = [], [], [], []
            for i, spans in enumerate(batch.column(2).to_pylist()):
                text = raw[offs[i]:offs[i + 1]]
                merged: list[list[int]] = []
                for s in sorted((s["a"], s["b"]) for s in spans or ()):
                    if merged and s[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s[1])
                    else:
                        merged.append(list(s))
                edges = [0, *(x for s in merged for x in s), len(text)]
                rest = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
                total.append(len(text))
                gone.append(len(text) - len(rest))
                many.append(len(merged))
                kept.append(hashlib.sha256(rest).hexdigest() if digest else rest)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in (total, gone, many)), pa.array(kept, pa.string() if digest else pa.binary())],
                                             names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])
    return cut


def repeated_spans(src: DataFrame, width: int, part: int) -> DataFrame:
    """(doc, key, spans of bytes to remove) of the texts (doc, key, text) that lose any."""
    spark = src.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    seg = staged(src.select("doc", "key", "text").mapInArrow(_segmenter(width, part), SEGMENT), "segments")
    shared = seg.groupBy("symbol").agg(F.count(F.lit(1)).alias("c"), F.min("segment").alias("s0"), F.max("segment").alias("s1")) \
        .where("c > 1").select("symbol", (F.col("s0") != F.col("s1")).alias("mixed"))
    # written, so that the join has a shuffle of its own and a very frequent symbol's rows can be split
    seg = staged(seg.join(staged(shared, "symbols"), "symbol"), "shared")

    first = staged(seg.where("mixed").groupBy("symbol", "segment").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("doc", "key", "at", "n", "anchor")).alias("of")), "distinct")
    large = first.groupBy("symbol").agg(F.count(F.lit(1)).alias("v")).select("symbol", (F.col("v") > MANY).alias("many"))
    todo = first.join(large, "symbol").select("of.doc", "of.key", F.struct("of.at", "of.n", "of.anchor", "symbol", "segment", "many").alias("cell")) \
        .groupBy("doc", "key").agg(F.collect_list("cell").alias("cells"))
    copies = src.join(todo, ["doc", "key"]).dropDuplicates(["doc", "key"]).select("text", "cells") \
        .mapInArrow(_copier(width), "symbol long, segment long, anchor int, many boolean, bytes binary")
    copies = staged(copies, "copies")
    sorted_ = copies.where("not many").select("symbol", "segment", "anchor", "bytes").repartition(n, "symbol").sortWithinPartitions("symbol", "segment") \
        .mapInArrow(_sorter(width, part), "symbol long, segment long, runs array<struct<x:int,y:int>>")
    windows = staged(copies.where("many").select("symbol", "segment", "bytes").mapInArrow(_windower(width), "symbol long, segment long, off int, window long"), "windows")
    twice = windows.groupBy("symbol", "window").agg(F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    dealt = windows.join(twice, ["symbol", "window"]).groupBy("symbol", "segment").agg(F.collect_list(F.struct(F.col("off").alias("x"), F.col("off").alias("y"))).alias("runs"))
    found = first.select("symbol", "segment", "c", F.col("of.n").alias("n")).join(sorted_.unionByName(dealt), ["symbol", "segment"], "left") \
        .select("symbol", "segment", F.when(F.col("c") > 1, F.array(F.struct(F.lit(0).alias("x"), (F.col("n") - 1).alias("y")))).otherwise(F.col("runs")).alias("runs"))

    whole = seg.where("not mixed").select("doc", "key", F.col("at").alias("a"), (F.col("at") + F.col("n") + (width - 1)).alias("b"))
    some = seg.where("mixed").select("doc", "key", "at", "symbol", "segment").join(staged(found.where("runs is not null"), "runs"), ["symbol", "segment"]) \
        .select("doc", "key", "at", F.explode("runs").alias("r")).select("doc", "key", (F.col("at") + F.col("r.x")).alias("a"), (F.col("at") + F.col("r.y") + width).alias("b"))
    return whole.unionByName(some).groupBy("doc", "key").agg(F.collect_set(F.struct("a", "b")).alias("spans"))


def remove_repeats(docs: DataFrame, *, width: int = 200, part: int = 64, digest: bool = False) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs),
    kept (the other bytes; with ``digest`` kept_sha256).

    A byte goes if a string of ``width`` bytes of its own text covers it that
    starts anywhere else too, in this text or another. One row per input row.
    Null, empty and short texts lose nothing; repeated rows are repeats of
    each other, whatever their ids; other columns are ignored.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"),
                      F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    spans = staged(repeated_spans(src, width, part), "spans")
    out = src.join(spans, ["doc", "key"], "left").select("doc_id", "text", "spans") \
        .mapInArrow(_remover(digest), f"doc_id long, n_bytes long, n_removed long, n_spans long, kept {'string' if digest else 'binary'}")
    return out.withColumnRenamed("kept", "kept_sha256") if digest else out
