"""Per-user ordered sequences, built so that no user ever lands whole in one task.

Output layout of every sequence table (``SEQ`` below):

    key, chunk INT, offset BIGINT, seq_len BIGINT, tokens ARRAY<T>

``tokens`` holds the user's positions ``[offset, offset + size(tokens))``;
chunk ``k`` starts at position ``k * chunk_len``. A user shorter than
``chunk_len`` is one row, exactly the reference's one-sequence-per-user;
a user holding a third of all rows becomes many bounded rows.

How the assembly scales (``assemble_sequences``):

1. range-partition events on (key, order...) so a hot key is spread over
   many partitions, then sort inside each partition;
2. walk each sorted partition once, batch by batch: a key that begins and ends
   inside a batch is *closed*, and its finished chunks are cut there; what
   touches a batch's first or last key is an *open* piece, at most two a
   batch (a hot key has one a batch, of at most ``piece_rows`` rows). Both are
   held packed (``_pack``): compressed, tokens as dictionary codes;
3. number the open pieces per key on a slim (key, piece, length) table, giving
   every piece its offset;
4. cut the open pieces at chunk boundaries and regroup them by (key, chunk),
   each group <= chunk_len. Closed keys' tokens are moved once, by the range shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.session import default_parallelism, hold

DEFAULT_CHUNK_LEN = 4096
PIECE_ROWS_LOG2 = 16  # pieces of at most 65,536 events


def _lit_array(values: Sequence, elem_type: str) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast(f"array<{elem_type}>")


def _elem_type(df: DataFrame, col: str) -> str:
    return df.schema[col].dataType.elementType.simpleString()


def assemble_sequences(events: DataFrame, key: str, order_by: Sequence[str], items: str, *,
                       sep=None, prefix: Sequence = (), suffix: Sequence = (),
                       chunk_len: int = DEFAULT_CHUNK_LEN, num_partitions: int | None = None,
                       piece_rows_log2: int = PIECE_ROWS_LOG2) -> DataFrame:
    """Concatenate each key's ``items`` arrays in ``order_by`` order.

    ``sep`` goes between consecutive events (not after the last), ``prefix``
    before the first and ``suffix`` after the last. Rows with a null key are
    dropped (pandas ``groupby`` semantics); a null ``items`` array counts as
    an empty one. Ties in ``order_by`` are broken by
    the items themselves, so the result never depends on partitioning.
    """
    if len(prefix) > chunk_len or len(suffix) > chunk_len:
        raise ValueError("prefix/suffix longer than chunk_len")
    order_by = list(order_by)
    etype = _elem_type(events, items)
    n_parts = num_partitions or default_parallelism(events.sparkSession)
    none = F.array().cast(f"array<{etype}>")
    ev = events.where(F.col(key).isNotNull()).select(key, *order_by, F.coalesce(F.col(items), none).alias("_items"))
    if sep is not None:
        ev = ev.withColumn("_items", F.concat(F.col("_items"), _lit_array([sep], etype)))

    # 1-2: range partition (hot keys spread), total sort inside, pieces.
    # the items break ties inside the partition sort. The pieces are held: both
    # branches must see the same ones
    ranged = (ev.repartitionByRange(n_parts, key, *order_by)
              .sortWithinPartitions(key, *order_by, "_items")
              .select(F.col(key).alias("_k"), "_items"))
    k_type, tok_type = ranged.schema["_k"].dataType, ranged.schema["_items"].dataType
    walk = _cut_pieces(list(prefix), list(suffix), 0 if sep is None else 1, chunk_len, 1 << piece_rows_log2)
    packed = hold(ranged.mapInArrow(walk, T.StructType([T.StructField("_k", k_type), *_PACKED_FIELDS])))
    closed = packed.where(F.col("_piece").isNull()).select("_z", "_pool").mapInArrow(
        _unpack(), T.StructType([T.StructField("_k", k_type), *_CHUNK_FIELDS, T.StructField("tokens", tok_type)])).withColumnRenamed("_k", key)
    opened = packed.where(F.col("_piece").isNotNull())
    pieces = opened.select("_z", "_pool").mapInArrow(
        _unpack(), T.StructType([T.StructField(key, k_type), T.StructField("_piece", T.LongType()), T.StructField("_n", T.LongType()), T.StructField("_tok", tok_type)]))

    # 3: offsets on the slim table.
    by_key = Window.partitionBy(key)
    slim = (opened.select(F.col("_k").alias(key), "_piece", "_n")
            .withColumn("_off", F.sum("_n").over(by_key.orderBy("_piece")) - F.col("_n"))
            .withColumn("_tot", F.sum("_n").over(by_key))
            .drop("_n"))
    p, s, L = len(prefix), len(suffix), chunk_len
    core_len = F.col("_tot") - F.lit(1 if sep is not None else 0)
    slow = (pieces.join(slim, [key, "_piece"])
            .withColumn("_core", core_len)
            .withColumn("_len", core_len + F.lit(p + s)))

    # 4: cut the pieces (and the prefix/suffix) at chunk boundaries.
    parts = [slow.select(key, "_len", (F.col("_off") + p).alias("_start"),
                         F.slice("_tok", 1, F.greatest(F.least(F.col("_n"), F.col("_core") - F.col("_off")),
                                                        F.lit(0)).cast("int")).alias("_seg"))]
    # a key's first piece, also where pieces of no tokens share its offset
    firsts = slow.groupBy(key).agg(F.max("_len").alias("_len"), F.max("_core").alias("_core"))
    if p:
        parts.append(firsts.select(key, "_len", F.lit(0).cast("bigint").alias("_start"),
                                   _lit_array(prefix, etype).alias("_seg")))
    if s:
        parts.append(firsts.select(key, "_len", (F.col("_core") + p).alias("_start"),
                                   _lit_array(suffix, etype).alias("_seg")))
    segs = parts[0]
    for extra in parts[1:]:
        segs = segs.unionByName(extra)
    # a key without any token keeps its one empty chunk
    segs = segs.where((F.size("_seg") > 0) | (F.col("_len") == 0)).withColumn("_end", F.col("_start") + F.size("_seg"))
    k = F.explode(F.sequence(F.floor(F.col("_start") / L), F.greatest(F.floor((F.col("_end") - 1) / L), F.lit(0)))).alias("chunk")
    cut = segs.select(key, "_len", "_start", "_end", "_seg", k)
    lo = F.greatest(F.col("chunk") * L, F.col("_start"))
    hi = F.least((F.col("chunk") + 1) * L, F.col("_end"))
    cut = cut.select(key, "_len", F.col("chunk").cast("int").alias("chunk"), lo.alias("_lo"),
                     F.slice("_seg", (lo - F.col("_start") + 1).cast("int"), (hi - lo).cast("int")).alias("_s"))
    regrouped = (cut.groupBy(key, "chunk")
                 .agg(F.max("_len").alias("seq_len"),
                      F.sort_array(F.collect_list(F.struct("_lo", "_s"))).alias("_segs"))
                 .select(key, "chunk", (F.col("chunk") * F.lit(L)).cast("bigint").alias("offset"), "seq_len",
                         F.flatten(F.transform("_segs", lambda x: x["_s"])).alias("tokens")))
    return closed.unionByName(regrouped)


_PACKED_FIELDS = [T.StructField("_piece", T.LongType()), T.StructField("_n", T.LongType()),
                  T.StructField("chunk", T.IntegerType()),  # the first one packed; null for a piece
                  T.StructField("_z", T.BinaryType()), T.StructField("_pool", T.BinaryType())]
_CHUNK_FIELDS = [T.StructField("chunk", T.IntegerType()), T.StructField("offset", T.LongType()), T.StructField("seq_len", T.LongType())]


def _starts(keys: pa.Array) -> np.ndarray:
    """Rows of a sorted column where another key begins."""
    if pa.types.is_floating(keys.type):
        keys = keys.dictionary_encode().indices  # NaN is one key
    if len(keys) < 2:
        return np.zeros(len(keys), np.int64)
    other = pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.flatnonzero(other) + 1])


def _spans(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... of each length, one after another."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + length, length)


UNPACKED = 1 << 18  # tokens of a batch that is unpacked, or one row


def _bytes(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _batch(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_next_batch()


def _pack(columns: list[pa.Array], lo: np.ndarray, hi: np.ndarray, pool: pa.Array) -> list[pa.Array]:
    """Rows with the tokens ``pool[lo:hi]`` as two values: the rows and the pool, each a
    compressed Arrow stream. Strings of the pool are coded by a dictionary, and
    tokens that several rows share are there once."""
    if pa.types.is_string(pool.type) or pa.types.is_large_string(pool.type):
        pool = pool.dictionary_encode()
    columns = [*columns, pa.array(lo.astype(np.int64)), pa.array(hi.astype(np.int64))]
    rows = pa.RecordBatch.from_arrays(columns, names=[f"c{i}" for i in range(len(columns))])
    return [pa.array([_bytes(x)], pa.binary()) for x in (rows, pa.RecordBatch.from_arrays([pool], names=["t"]))]


def _unpack() -> Callable:
    """Batches of (_z, _pool) back to the rows they hold, their tokens last."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for z, p in zip(b.column(0), b.column(1)):
                rows, pool = _batch(z.as_py()), _batch(p.as_py()).column(0)
                *columns, lo, hi = rows.columns
                lo, size = lo.to_numpy(), hi.to_numpy() - lo.to_numpy()
                ends, at = np.cumsum(size), 0
                while at < len(rows):
                    to = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + UNPACKED, side="right")), at + 1)
                    tokens = pool.take(pa.array(_spans(lo[at:to], size[at:to])))
                    if pa.types.is_dictionary(tokens.type):
                        tokens = tokens.dictionary_decode()
                    offsets = pa.array(np.append(0, np.cumsum(size[at:to])).astype(np.int32))
                    arrays = [*[c.slice(at, to - at) for c in columns], pa.ListArray.from_arrays(offsets, tokens)]
                    yield pa.RecordBatch.from_arrays(arrays, names=[f"c{i}" for i in range(len(arrays))])
                    at = to
    return run


def _cut_pieces(prefix: list, suffix: list, extra: int, chunk_len: int, piece_rows: int) -> Callable:
    """The walk over a sorted partition of (key, items): finished chunks of the
    keys inside a batch, packed as one row, and numbered pieces (``_n``: their tokens) of the others."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            if not len(batch):
                continue
            keys, items = batch.columns
            at, values = items.offsets.to_numpy().astype(np.int64), items.values
            runs = np.append(_starts(keys), len(batch))
            n_runs = len(runs) - 1
            inner = np.arange(n_runs)[1:-1]
            inner = inner[runs[inner + 1] - runs[inner] <= piece_rows]
            outer = np.setdiff1d(np.arange(n_runs), inner)
            if len(inner):
                first, core = at[runs[inner]], at[runs[inner + 1]] - at[runs[inner]] - extra
                pool = pa.concat_arrays([values, pa.array(prefix + suffix, values.type)]) if prefix or suffix else values
                p, s, base = len(prefix), len(suffix), len(values)
                n = core + p + s
                tokens = pool.take(pa.array(_spans(np.stack([np.full_like(first, base), first, np.full_like(first, base + p)], 1).ravel(),
                                                   np.stack([np.full_like(core, p), core, np.full_like(core, s)], 1).ravel())))
                chunks = np.maximum(-(-n // chunk_len), 1)
                of, k = np.repeat(np.arange(len(inner)), chunks), _spans(np.zeros_like(chunks), chunks)
                starts = (np.cumsum(n) - n)[of] + k * chunk_len
                columns = [keys.take(pa.array(runs[inner][of])), pa.array(k.astype(np.int32)), pa.array(k * chunk_len), pa.array(n[of])]
                yield pa.RecordBatch.from_arrays([
                    pa.nulls(1, keys.type), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([0], pa.int32()),
                    *_pack(columns, starts, np.append(starts[1:], n.sum()), tokens)], names=_NAMES)
            for r in outer:
                for lo in range(runs[r], runs[r + 1], piece_rows):
                    hi = min(lo + piece_rows, runs[r + 1])
                    part = values.slice(at[lo], at[hi] - at[lo])
                    named = [keys.slice(lo, 1), pa.array([number], pa.int64()), pa.array([len(part)], pa.int64())]
                    yield pa.RecordBatch.from_arrays([*named, pa.nulls(1, pa.int32()), *_pack(named, np.zeros(1), np.full(1, len(part)), part)], names=_NAMES)
                    number += 1
    return run


_NAMES = ["_k", "_piece", "_n", "chunk", "_z", "_pool"]


# ---------------------------------------------------------------------------
# Windows over a sequence table (W1-W4). All results are bounded by n.

def _regroup(seqs: DataFrame, key: str, keep: Column) -> DataFrame:
    """Flatten the kept chunks of each key (caller bounds their total size)."""
    return (seqs.where(keep).groupBy(key)
            .agg(F.max("seq_len").alias("seq_len"), F.min("offset").alias("offset"),
                 F.sort_array(F.collect_list(F.struct("chunk", "tokens"))).alias("_c"))
            .select(key, "seq_len", "offset", F.flatten(F.transform("_c", lambda c: c["tokens"])).alias("tokens")))


def head_tokens(seqs: DataFrame, key: str, n: int, chunk_len: int | None = None) -> DataFrame:
    """First ``n`` tokens per key (the oldest; pretraining keeps ``ctx + 1``).

    When the caller knows the table's ``chunk_len`` and ``n`` fits in it, the
    window is a slice of chunk 0: a projection, no shuffle."""
    if chunk_len is not None and n <= chunk_len:
        return seqs.where(F.col("chunk") == 0).select(key, "seq_len", F.slice("tokens", 1, n).alias("tokens"))
    g = _regroup(seqs, key, F.col("offset") < F.lit(n))
    return g.select(key, "seq_len", F.slice("tokens", 1, n).alias("tokens"))


def tail_tokens(seqs: DataFrame, key: str, n: int) -> DataFrame:
    """Last ``n`` tokens per key (the newest; prediction context)."""
    keep = F.col("offset") + F.size("tokens") > F.col("seq_len") - F.lit(n)
    g = _regroup(seqs, key, keep)
    start = F.greatest(F.size("tokens") - F.lit(n), F.lit(0)) + 1
    return g.select(key, "seq_len", F.slice("tokens", start, n).alias("tokens"))


def drop_tail(seqs: DataFrame, key: str, n: int) -> DataFrame:
    """The sequence table without its last ``n`` tokens (chunked, unbounded)."""
    cut = F.col("seq_len") - F.lit(n)
    out = seqs.where(F.col("offset") < cut)
    keep = F.least(F.size("tokens"), (cut - F.col("offset")).cast("int"))
    return out.select(key, "chunk", "offset", cut.alias("seq_len"), F.slice("tokens", 1, keep).alias("tokens"))


def holdout(seqs: DataFrame, key: str, n: int) -> tuple[DataFrame, DataFrame]:
    """(input = all but the last ``n`` tokens, chunked; actual = last ``n``)."""
    actual = tail_tokens(seqs, key, n).select(key, F.col("tokens").alias("actual"))
    return drop_tail(seqs, key, n), actual


def next_token_pairs(windowed: DataFrame, col: str = "tokens") -> DataFrame:
    """``x = seq[:-1]``, ``y = seq[1:]`` on a bounded window (e.g. head_tokens)."""
    n = F.size(col)
    return windowed.withColumn("x", F.slice(col, 1, F.greatest(n - 1, F.lit(0)))) \
                   .withColumn("y", F.when(n > 1, F.slice(col, 2, F.greatest(n - 1, F.lit(0))))
                               .otherwise(F.slice(col, 1, 0)))


def tokens_long(seqs: DataFrame, key: str) -> DataFrame:
    """Long form (key, pos, token): one row per position, pos 0-based."""
    return seqs.select(key, "offset", F.posexplode("tokens").alias("_i", "token")) \
               .select(key, (F.col("offset") + F.col("_i")).alias("pos"), "token")


# ---------------------------------------------------------------------------
# Windows taken before the assembly

CUT_SALTS = 32


def edge_tokens(events: DataFrame, key: str, order_by: Sequence[str], items: str, n: int, *, newest: bool = True, sep=None, least_items: int = 0) -> DataFrame:
    """W2 / W3 ahead of A1: (key, seq_len, tokens), the last (or first) ``n`` tokens
    of each key's sequence, equal to ``tail_tokens`` (``head_tokens``) of the
    assembled one, but no more than the events that can hold them are moved.

    An event has ``least_items`` tokens or more (and its separator), so the window
    lies in that many events at most. The ranked filters are executed with a
    limit per group before each shuffle: a task sends at most that many
    events of a key, first by (key, salt), then by key, so a key with a third of all
    rows ends as ``CUT_SALTS`` times that many events in one task. ``seq_len``
    is a sum combined in the tasks. Events without tokens are left out where there
    is no separator (they add nothing)."""
    etype = _elem_type(events, items)
    extra = 0 if sep is None else 1
    most = -(-(n + extra) // max(least_items + extra, 1))
    toks = F.coalesce(F.col(items), F.array().cast(f"array<{etype}>"))
    ev = events.where(F.col(key).isNotNull()).select(key, *order_by, toks.alias("_items"))
    if sep is None:
        ev = ev.where(F.size("_items") > 0)
    total = ev.groupBy(key).agg((F.sum(F.size("_items") + extra) - extra).cast("bigint").alias("seq_len"))
    order = [F.desc(c) if newest else F.asc(c) for c in [*order_by, "_items"]]
    salted = ev.withColumn("_salt", F.pmod(F.xxhash64(*order_by, "_items"), F.lit(CUT_SALTS)))
    near = salted.withColumn("_r", F.row_number().over(Window.partitionBy(key, "_salt").orderBy(*order))).where(F.col("_r") <= most)
    near = near.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_r") <= most)
    rows = F.sort_array(F.collect_list(F.struct("_r", "_items")), asc=not newest)
    one = F.transform("_rows", lambda r: r["_items"] if sep is None else F.concat(r["_items"], _lit_array([sep], etype)))
    flat = near.groupBy(key).agg(rows.alias("_rows")).select(key, F.flatten(one).alias("_flat")).join(total, key)
    size = F.size("_flat")
    if newest:  # without the separator after the last event
        last = size - extra
        tokens = F.slice("_flat", F.greatest(last - n, F.lit(0)) + 1, F.least(last, F.lit(n)))
    else:
        tokens = F.slice("_flat", 1, F.least(F.lit(n), F.col("seq_len").cast("int"), size))
    return flat.select(key, "seq_len", tokens.alias("tokens"))


# ---------------------------------------------------------------------------
# As-of windows

def windows_as_of(events: DataFrame, labels: DataFrame, key: str, order_by: Sequence[str], items: str, row_id: str, as_of: str, n: int, sep=None) -> DataFrame:
    """``labels`` with ``hi`` and ``tokens``: the last ``n`` tokens of the key's events dated at
    or before the row's time (without the separator that ends the last event), and
    the position in the key's sequence where they end; ``hi`` is null for rows that
    are not ``_twin`` and need no token of another partition.

    Events and label rows are merged on (key, time) by one range shuffle, so a key
    with a third of all rows is spread over many tasks, and a partition is walked in
    order: each label row takes the tokens just before it. What the walk gives is
    held packed, the shared tokens of windows once. Where a partition begins
    inside a key, its first label rows need tokens of the partitions before, too: each
    partition hands on its last key's newest tokens and their number (one row a
    partition, broadcast)."""
    spark, extra = events.sparkSession, 0 if sep is None else 1
    etype = _elem_type(events, items)
    none = F.array().cast(f"array<{etype}>")
    own = F.coalesce(F.col(items), none) if sep is None else F.concat(F.coalesce(F.col(items), none), _lit_array([sep], etype))
    rest = [f"_o{i}" for i in range(1, len(order_by))]
    carried = [f"_l{i}" for i in range(len(labels.columns))]
    e = events.where(F.col(key).isNotNull()).select(
        F.col(key).alias("_k"), F.col(order_by[0]).alias("_t"), F.lit(0).alias("_kind"), *[F.col(c).alias(o) for c, o in zip(order_by[1:], rest)], own.alias("_items"),
        *[F.lit(None).cast(labels.schema[c].dataType).alias(x) for c, x in zip(labels.columns, carried)])
    rows = labels.select(
        F.col(key).alias("_k"), F.col(as_of).alias("_t"), F.lit(1).alias("_kind"), *[F.lit(None).cast(events.schema[c].dataType).alias(o) for c, o in zip(order_by[1:], rest)],
        none.alias("_items"), *[F.col(c).alias(x) for c, x in zip(labels.columns, carried)])
    order = ["_k", "_t", "_kind", *rest, carried[labels.columns.index(row_id)]]
    ranged = e.unionByName(rows).repartitionByRange(default_parallelism(spark), *order).sortWithinPartitions(*order, "_items")
    ranged = ranged.select("_k", "_kind", "_items", *carried)
    k_field, toks = T.StructField("_k", ranged.schema["_k"].dataType), T.StructField("tokens", ranged.schema["_items"].dataType)
    walk = _take_windows(n, extra, 3 + labels.columns.index("_twin"))
    walked = hold(ranged.mapInArrow(walk, T.StructType([k_field, *_WINDOW_FIELDS, toks])))
    fields = [T.StructField(x, ranged.schema[x].dataType) for x in carried]
    named = [F.col(x).alias(c) for c, x in zip(labels.columns, carried)]
    done = walked.where(~F.col("_open")).select("_z", "_pool").mapInArrow(_unpack(), T.StructType([*fields, toks]))

    opened = walked.where(F.col("_open")).select("_z", "_pool").mapInArrow(
        _unpack(), T.StructType([*fields, k_field, T.StructField("_p", T.IntegerType()), T.StructField("_goes_on", T.BooleanType()), T.StructField("_here", T.LongType()), toks]))
    edges = walked.where(F.col("_open").isNull()).groupBy(F.col("_k").alias("_ek")).agg(F.array_sort(F.collect_list(F.struct("_p", "_n", "tokens"))).alias("_edges"))
    j = opened.join(F.broadcast(edges), F.col("_goes_on") & (F.col("_k") == F.col("_ek")), "left")
    j = j.withColumn("_before", F.when(F.col("_edges").isNotNull(), F.filter("_edges", lambda x: x["_p"] < F.col("_p"))).otherwise(F.array().cast(j.schema["_edges"].dataType)))
    j = j.withColumn("_all", F.concat(F.flatten(F.transform("_before", lambda x: x["tokens"])), F.col("tokens")))
    end = F.greatest(F.size("_all") - extra, F.lit(0))
    hi = F.greatest(F.col("_here") + F.aggregate("_before", F.lit(0).cast("bigint"), lambda a, x: a + x["_n"]) - extra, F.lit(0).cast("bigint"))
    opened = j.select(*named, hi.alias("hi"), F.slice("_all", F.greatest(end - n, F.lit(0)) + 1, F.least(end, F.lit(n))).alias("tokens"))
    return done.select(*named, F.lit(None).cast("bigint").alias("hi"), "tokens").unionByName(opened)


_WINDOW_FIELDS = [T.StructField("_p", T.IntegerType()), T.StructField("_open", T.BooleanType()), T.StructField("_n", T.LongType()),
                  T.StructField("_z", T.BinaryType()), T.StructField("_pool", T.BinaryType())]


def _take_windows(n: int, extra: int, twin: int) -> Callable:
    """The walk over a sorted partition of (key, kind, items, label columns): label
    rows (kind 1) with the ``n`` tokens before them, or, ``_open``, with the newest
    tokens and the number of tokens since the partition's start, where these may not
    be enough or the row's place is asked for; at last one row with the newest
    tokens of the last key (``_open`` is null)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, tail, last, gone, fresh = TaskContext.get().partitionId(), None, None, 0, True
        for batch in batches:
            if not len(batch):
                continue
            keys, kind, items = batch.columns[:3]
            if last is None:
                tail = items.values.slice(0, 0)
            elif len(_starts(pa.concat_arrays([last, keys.slice(0, 1)]))) > 1:
                tail, gone, fresh = tail.slice(0, 0), 0, False  # another key
            at = items.offsets.to_numpy().astype(np.int64)
            pool = pa.concat_arrays([tail, items.values.slice(at[0], at[-1] - at[0])])
            at = at - at[0] + len(tail)
            runs = _starts(keys)
            begins = at[runs]
            begins[0] = 0  # of the first key, ``gone`` tokens are not in the pool
            rows = np.flatnonzero(kind.to_numpy() == 1)
            run_of = np.searchsorted(runs, rows, side="right") - 1
            since, here = begins[run_of], at[rows]
            count = here - since + np.where(run_of == 0, gone, 0)
            goes_on = (run_of == 0) & fresh
            is_open = (goes_on & (count < n + extra)) | batch.column(twin).take(pa.array(rows)).to_numpy(zero_copy_only=False).astype(bool)
            hi = np.maximum(here - extra, since)
            for opened, lo, to in ((False, np.maximum(hi - n, since), hi), (True, np.maximum(here - n - extra, since), here)):
                mine = np.flatnonzero(is_open == opened)
                if len(mine):
                    columns = [c.take(pa.array(rows[mine])) for c in batch.columns[3:]]
                    if opened:
                        columns += [keys.take(pa.array(rows[mine])), pa.array(np.full(len(mine), place, np.int32)), pa.array(goes_on[mine]), pa.array(count[mine])]
                    yield pa.RecordBatch.from_arrays([pa.nulls(1, keys.type), pa.nulls(1, pa.int32()), pa.array([opened]), pa.nulls(1, pa.int64()),
                                                      *_pack(columns, lo[mine], to[mine], pool), pa.nulls(1, items.type)], names=_WINDOWS)
            fresh = fresh and len(runs) == 1
            start = max(begins[-1], len(pool) - n - extra)
            gone = int(start - begins[-1]) + (gone if len(runs) == 1 else 0)
            tail = pa.concat_arrays([pool.slice(start)])
            last = keys.slice(len(keys) - 1, 1)
        if last is not None:
            yield pa.RecordBatch.from_arrays([last, pa.array([place], pa.int32()), pa.nulls(1, pa.bool_()), pa.array([gone + len(tail)], pa.int64()),
                                              pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(tail)], pa.int32()), tail)], names=_WINDOWS)
    return run


_WINDOWS = ["_k", *[x.name for x in _WINDOW_FIELDS], "tokens"]


def label_sequences_as_of(events: DataFrame, labels: DataFrame, key: str, order_by: Sequence[str], items: str, row_id: str, as_of: str, n: int, *,
                          sep=None, chunk_len: int = DEFAULT_CHUNK_LEN) -> DataFrame:
    """J2 with a time cut: every label row with the last ``n`` tokens of its
    key's events dated (first column of ``order_by``) at or before the row's
    own ``as_of``. No later event is in a sequence. Rows without such an event,
    without a key or without a time get an empty array.

    Tokens are moved once, to the label rows (``windows_as_of``). ``row_id`` is meant
    to be unique: rows that share one get their windows by id, cut at the chunks
    of ``chunk_len`` and these one after another."""
    etype = _elem_type(events, items)
    none = F.array().cast(f"array<{etype}>")
    columns = [row_id, *[c for c in labels.columns if c != row_id]]
    labels = labels.select(*columns)
    counted = labels.where(F.col(row_id).isNotNull()).withColumn("_twin", F.count(F.lit(1)).over(Window.partitionBy(row_id)) > 1)
    placeable = F.col(key).isNotNull() & F.col(as_of).isNotNull()
    windows = windows_as_of(events.where(F.col(order_by[0]).isNotNull()), counted.where(placeable), key, order_by, items, row_id, as_of, n, sep)

    low = F.greatest(F.col("hi") - n, F.lit(0).cast("bigint"))
    cuts = F.when(F.col("hi") > 0, F.sequence(F.floor(low / chunk_len), F.floor((F.col("hi") - 1) / chunk_len)))

    def part(k: Column) -> Column:
        lo, hi = F.greatest(low, k * chunk_len), F.least(F.col("hi"), (k + 1) * chunk_len)
        return F.struct(k.cast("int").alias("chunk"), F.slice("tokens", (lo - low + 1).cast("int"), (hi - lo).cast("int")).alias("_s"))

    shared = windows.where(F.col("hi").isNotNull() & F.col("_twin")).select(F.col(row_id).alias("_id"), F.explode(F.transform(cuts, part)).alias("_c"))
    shared = shared.groupBy("_id").agg(F.array_sort(F.collect_list("_c")).alias("_c")).select("_id", F.flatten(F.transform("_c", lambda c: c["_s"])).alias("tokens"))
    twins = counted.where("_twin").join(shared, F.col(row_id) == F.col("_id"), "left")
    return windows.where(~F.col("_twin")).select(*columns, "tokens") \
        .unionByName(counted.where(~F.col("_twin") & ~placeable).select(*columns, none.alias("tokens"))) \
        .unionByName(labels.where(F.col(row_id).isNull()).withColumn("tokens", none)) \
        .unionByName(twins.select(*columns, F.coalesce(F.col("tokens"), none).alias("tokens")))
