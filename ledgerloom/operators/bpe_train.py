"""Byte-pair training with pair counts kept by signed changes.

The distinct words of the corpus lie in *blocks*, one row each: the words'
symbols one after another (two bytes each, where the ids fit) and their counts.
The blocks are written to the shared folder. A task indexes the places of the
pairs it is about to merge and of no others: one pass over the symbols; a merge
then touches only the places that the index names, so its cost follows the
words it changes.

The driver keeps the pairs of the highest ranks (``tracked`` at most) with
their exact counts. All pairs ranked before ``bound`` are among them: a pair's
count only falls, unless the pair holds a token of a later merge, and then
its whole count is in the changes of that merge.

A *round* is one job. The driver guesses the next merges in order; each task
brings its blocks up to date, applies the guessed merges one after another and
returns, for every step, the signed changes of the pair counts, added up over
the blocks. The driver then replays: as long as the true next merge (the
highest count, ties to the smallest ids) is among the guesses and its changes
do not depend on guesses that were wrong (``_apart``), it is accepted and its
changes are applied; the other guesses are thrown away. Then merges follow
whose changes are not known yet but cannot matter (``certain``); the next
round returns theirs first. So the merges equal those of the one-at-a-time
algorithm, whatever the guesses.

Accepted merges that the written blocks do not hold yet travel with the next
rounds' tasks (``pending``); after some (32, then twice as many up to
``rewrite_after``) the blocks are written anew. A lost executor costs the tasks it ran: blocks are read from the
shared folder, and merges are replayed. When the tracked pairs are used up,
or a merge gives a string that already is a token (then old tokens' pairs may
gain), all pairs are counted once more.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.session import drop_written, written

BLOCK_SYMBOLS = 1 << 22
ROUND_PARTITIONS = 24  # a round's sum has some steps times the vocabulary rows, whatever the input
GAP, HOLE = -1, -2  # between words; a symbol that went into the one before it
_BITS = 32
_LOW = (1 << _BITS) - 1
_BLOCKS = "cnt binary, sym binary, width int"
Merge = tuple[int, int, int]


def pair_key(left, right):
    return (left << _BITS) | right


def _added(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values added up by key, keys in order."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(values, first)


def _distinct(x: np.ndarray) -> np.ndarray:
    """In order, each once; ``np.unique`` hashes, which is slower here."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


class Block:
    """Some words' symbols, with the places of every adjacent pair."""

    def __init__(self, cnt: np.ndarray, sym: np.ndarray, merges: Sequence[Merge] | None = None):
        """With ``merges`` only their pairs are indexed: no other may be merged."""
        self.cnt, self.sym = cnt, np.array(sym, np.int32)  # a copy: merges write to it
        self.ends = np.flatnonzero(self.sym == GAP)[1:]    # the gap after each word; the first gap stands before all
        self.nxt = np.arange(1, len(sym) + 1, dtype=np.int32)
        self.prv = np.arange(-1, len(sym) - 1, dtype=np.int32)
        self.wanted = None if merges is None else np.unique(np.array([pair_key(left, right) for left, right, _ in merges], np.int64))
        self.index: tuple[np.ndarray, np.ndarray] | None = None  # pairs in order beside their places, by the first merge
        self.later: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}  # by token: pairs that came with it
        self.touched = 0

    @classmethod
    def of_words(cls, words: Sequence[Sequence[int]], cnt: Sequence[int]) -> Block:
        flat = [GAP]
        for w in words:
            flat.extend(w)
            flat.append(GAP)
        return cls(np.array(cnt, np.int64), np.array(flat, np.int32))

    def row(self) -> tuple[bytes, bytes, int]:
        width = 2 if self.sym.max(initial=0) < 1 << 15 else 4
        return self.cnt.tobytes(), self.sym.astype(f"i{width}").tobytes(), width

    @classmethod
    def of_row(cls, cnt: bytes, sym: bytes, width: int, merges: Sequence[Merge] | None = None) -> Block:
        return cls(np.frombuffer(cnt, np.int64), np.frombuffer(sym, f"i{width}"), merges)

    def _keys(self, at: np.ndarray) -> np.ndarray:
        return pair_key(self.sym[at].astype(np.int64), self.sym[self.nxt[at]].astype(np.int64))

    def _weights(self, at: np.ndarray) -> np.ndarray:
        return self.cnt[np.searchsorted(self.ends, at)]

    def _pairs(self) -> np.ndarray:
        """The places of a block without merges where a wanted pair may stand."""
        left, right = self.sym[:-1], self.sym[1:]
        if self.wanted is None:
            return np.flatnonzero((left >= 0) & (right >= 0)).astype(np.int32)
        # a symbol's place in the tables is its id; the last one is that of GAP
        size = int(max(self.sym.max(), self.wanted.max(initial=0) >> _BITS, (self.wanted & _LOW).max(initial=0))) + 2
        opens, closes = np.zeros(size, bool), np.zeros(size, bool)
        opens[self.wanted >> _BITS] = True
        closes[self.wanted & _LOW] = True
        return np.flatnonzero(opens[left] & closes[right]).astype(np.int32)

    def _indexed(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The wanted pairs at some places, in order, beside their places."""
        keys = self._keys(at)
        rank = keys
        if self.wanted is not None:
            if not len(self.wanted):
                return keys[:0], at[:0]
            rank = np.searchsorted(self.wanted, keys)
            here = np.flatnonzero(self.wanted[np.minimum(rank, len(self.wanted) - 1)] == keys)
            keys, at, rank = keys[here], at[here], rank[here]
            if len(self.wanted) <= 1 << 16:
                rank = rank.astype(np.uint16)  # numpy orders these by radix
        order = np.argsort(rank, kind="stable")
        return keys[order], at[order]

    def _places(self, left: int, right: int) -> np.ndarray:
        """Where the pair stands now, in order."""
        key = pair_key(left, right)
        if self.index is None:
            self.index = self._indexed(self._pairs())
        found = []
        for keys, at in [self.index, *self.later.get(left, ()), *(self.later.get(right, ()) if left != right else ())]:
            lo, hi = np.searchsorted(keys, [key, key + 1])
            if lo < hi:
                found.append(at[lo:hi])
        if not found:
            return np.zeros(0, np.int32)
        at = found[0] if len(found) == 1 else _distinct(np.concatenate(found))
        return at[(self.sym[at] == left) & (self.sym[self.nxt[at]] == right)]

    def merge(self, left: int, right: int, new: int, counted: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Merge the pair wherever it stands, left to right; returns the changed
        pairs' keys and the signed changes of their counts, or nothing where
        these are not ``counted``."""
        at = self._places(left, right)
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(at):
            return none
        sym, nxt, prv = self.sym, self.nxt, self.prv
        if left == right:  # of a run of equal symbols every second pair is merged
            k = np.arange(len(at))
            goes_on = np.concatenate([[False], prv[at[1:]] == at[:-1]])
            start = np.maximum.accumulate(np.where(goes_on, 0, k))
            at = at[(k - start) % 2 == 0]
        self.touched += len(at)
        gone = nxt[at]
        before, after = prv[at], nxt[gone]
        if counted:
            old = _distinct(np.concatenate([before[sym[before] >= 0], at, gone[sym[after] >= 0]]))
            old_keys = self._keys(old)
        sym[at], sym[gone] = new, HOLE
        nxt[at] = after
        prv[after] = at
        before, after = prv[at], nxt[at]
        made = _distinct(np.concatenate([before[sym[before] >= 0], at[sym[after] >= 0]]))
        self.later.setdefault(new, []).append(self._indexed(made))
        if not counted:
            return none
        made_keys = self._keys(made)
        return _added(np.concatenate([old_keys, made_keys]), np.concatenate([-self._weights(old), self._weights(made)]))

    def compact(self) -> Block | None:
        """The words as they are now; a word of one symbol is done."""
        here = np.flatnonzero(self.sym != HOLE)
        sym = self.sym[here]
        ends = np.flatnonzero(sym == GAP)
        live = np.diff(ends) > 2  # two symbols or more
        if not live.any():
            return None
        keep = np.concatenate([[True], np.repeat(live, np.diff(ends))])
        return Block(self.cnt[live], sym[keep])

    def pair_counts(self) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of a block without merges, with their counts."""
        at = np.flatnonzero((self.sym[:-1] >= 0) & (self.sym[1:] >= 0)).astype(np.int32)
        return _added(self._keys(at), self._weights(at))


# ---------------------------------------------------------------- tasks

def _rows(batches: Iterator[pa.RecordBatch], merges: Sequence[Merge] = ()) -> Iterator[Block]:
    for batch in batches:
        cnt, sym, width = batch.columns
        for k in range(len(batch)):
            yield Block.of_row(memoryview(cnt[k].as_buffer()), memoryview(sym[k].as_buffer()), width[k].as_py(), merges)


def _batch(block: Block) -> pa.RecordBatch:
    cnt, sym, width = block.row()
    return pa.RecordBatch.from_arrays([pa.array([cnt], pa.binary()), pa.array([sym], pa.binary()), pa.array([width], pa.int32())],
                                      names=["cnt", "sym", "width"])


def _changes_schema() -> str:
    return "step int, key long, change long"


def _changes(step: int, keys: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), step, np.int32)), pa.array(keys), pa.array(values)], names=["step", "key", "change"])


def make_blocks(histogram: DataFrame, ids: dict[str, int], block_symbols: int = BLOCK_SYMBOLS) -> DataFrame:
    """Blocks of the words of a (word, cnt) histogram, as symbols of their characters."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, cnt, size = [], [], 0
        for batch in batches:
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if len(word) < 2:
                    continue
                words.append([ids[ch] for ch in word])
                cnt.append(n)
                size += len(word)
                if size >= block_symbols:
                    yield _batch(Block.of_words(words, cnt))
                    words, cnt, size = [], [], 0
        if words:
            yield _batch(Block.of_words(words, cnt))
    return histogram.select("word", F.col("cnt").cast("long")).mapInArrow(run, _BLOCKS)


def _stored(blocks: DataFrame) -> tuple[str, DataFrame]:
    """Blocks written to the shared folder and read from there once; a block lost
    with its executor is read again."""
    path, table = written(blocks, "bpe")
    return path, table.persist(StorageLevel.MEMORY_AND_DISK)


def _dropped(path: str, blocks: DataFrame) -> None:
    blocks.unpersist()
    drop_written(blocks.sparkSession, path)


def _rewritten(blocks: DataFrame, pending: list[Merge]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _rows(batches, pending):
            for m in pending:
                block.merge(*m, counted=False)
            compact = block.compact()
            if compact is not None:
                yield _batch(compact)
    return blocks.mapInArrow(run, _BLOCKS)


def _all_pairs(blocks: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _rows(batches):
            yield _changes(0, *block.pair_counts())
    return blocks.mapInArrow(run, _changes_schema()).groupBy("key").agg(F.sum("change").alias("cnt"))


def _round(blocks: DataFrame, pending: list[Merge], steps: list[Merge], tracked: np.ndarray, least: int) -> DataFrame:
    """(step, key, change): what each merge changes, without the losses of
    pairs that are not tracked and the gains that rank below all that are."""
    first_new = min(m[2] for m in steps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _rows(batches, [*pending, *steps]):
            for m in pending:
                block.merge(*m, counted=False)
            for step, m in enumerate(steps):
                keys, values = block.merge(*m)
                at = np.minimum(np.searchsorted(tracked, keys), max(len(tracked) - 1, 0))
                known = (tracked[at] == keys) if len(tracked) else np.zeros(len(keys), bool)
                use = (values > 0) | known | ((keys >> _BITS) >= first_new) | ((keys & _LOW) >= first_new)
                if use.any():
                    yield _changes(step, keys[use], values[use])
    summed = blocks.mapInArrow(run, _changes_schema()).groupBy("step", "key").agg(F.sum("change").alias("change"))
    return summed.where((F.col("change") < 0) | (F.col("change") >= F.lit(least)))


# ---------------------------------------------------------------- driver

class Ranking:
    """The pairs of the highest ranks: most frequent first, then smallest ids."""

    def __init__(self, most: int):
        self.most = most
        self.count: dict[int, int] = {}
        self.heap: list[tuple[int, int]] = []
        self.gone: dict[int, int] = {}  # counts of the pairs merged without knowing the changes
        self.bound: tuple[int, int] | None = None  # every pair before it is here; none: all pairs are

    def reset(self, rows: list[tuple[int, int]]) -> None:
        """From the first ``most`` + 1 pairs in rank order."""
        self.bound = (-rows[self.most][1], rows[self.most][0]) if len(rows) > self.most else None
        self.count = dict(rows[:self.most])
        self.heap = [(-n, key) for key, n in self.count.items()]
        heapq.heapify(self.heap)

    def least(self) -> int:
        return 1 if self.bound is None else -self.bound[0]

    def change(self, key: int, by: int) -> None:
        n = self.count.get(key, 0) + by
        if key not in self.count and self.bound is not None and (-n, key) >= self.bound:
            return  # ranks behind all that are tracked, and can only fall
        if n <= 0:
            self.count.pop(key, None)
            return
        self.count[key] = n
        heapq.heappush(self.heap, (-n, key))

    def best(self) -> tuple[int, int] | None:
        """(key, count) of the next merge, or None where the tracked pairs do not tell."""
        while self.heap:
            n, key = self.heap[0]
            if self.count.get(key) == -n:
                return (key, -n) if self.bound is None or (n, key) < self.bound else None
            heapq.heappop(self.heap)
        return None

    def trim(self) -> None:
        if len(self.count) > 2 * self.most:
            self.reset(sorted(self.count.items(), key=lambda x: (-x[1], x[0])))

    def guesses(self, most: int, unresolved: list[Merge]) -> list[tuple[int, int]]:
        """The next merges, as far as one can tell: pairs in rank order, where a
        pair that shares its inner symbol with an earlier merge is expected to
        lose the share of that symbol's occurrences that the merge takes, where
        that is more than half (mostly a pair loses much or nothing)."""
        keys = np.fromiter(self.count, np.int64, len(self.count))
        n = np.fromiter(self.count.values(), np.float64, len(self.count))
        all_left, all_right = np.bincount(keys >> _BITS, n), np.bincount(keys & _LOW, n)
        as_left: dict[int, float] = {}   # share of a symbol's occurrences that merges take as their left part
        as_right: dict[int, float] = {}

        def taken(left: int, right: int, count: int) -> None:
            if left < len(all_left) and right < len(all_right):
                as_left[left] = as_left.get(left, 0.0) + count / max(all_left[left], count, 1)
                as_right[right] = as_right.get(right, 0.0) + count / max(all_right[right], count, 1)
        for left, right, _ in unresolved:
            taken(left, right, self.gone[pair_key(left, right)])
        back, out = [], []
        while len(back) < 4 * most and self.best() is not None:
            back.append(heapq.heappop(self.heap))
        queue = [(float(x), key) for x, key in back]  # in order, so a heap
        while queue and len(out) < most:
            expected, key = heapq.heappop(queue)
            left, right = key >> _BITS, key & _LOW
            rest = max(0.0, 1 - as_right.get(left, 0.0)) * max(0.0, 1 - as_left.get(right, 0.0))
            now = -self.count[key] * rest
            if rest < 0.5 and now > expected + 0.5:  # less than it was when it came into the queue
                if now < -0.5:
                    heapq.heappush(queue, (now, key))
                continue
            out.append((left, right))
            taken(left, right, self.count[key])
        for x in back:
            heapq.heappush(self.heap, x)
        return out

    def certain(self, tokens: list[str], token_id: dict[str, int], vocab_size: int, least: int) -> list[Merge]:
        """Merges that come next whatever the changes of those before them in this
        list turn out to be. Merging (a, b) takes occurrences only from pairs
        that end with a or begin with b, and a pair it makes is at most as
        frequent as the one of these that it grows from. So the next best
        pair is right as long as it is none of these itself: all that may
        come out above it would have to grow from a pair ranked above it.
        A pair of two equal symbols grows from itself, and a merge that gives an
        old token lets old pairs gain: both end the list before them."""
        out: list[Merge] = []
        ends, begins = set(), set()
        while len(tokens) < vocab_size:
            best = self.best()
            if best is None or best[1] < least:
                break
            left, right = best[0] >> _BITS, best[0] & _LOW
            string = tokens[left] + tokens[right]
            if left == right or left in begins or right in ends or string in token_id:
                break
            out.append((left, right, len(tokens)))
            token_id[string] = len(tokens)
            tokens.append(string)
            ends.add(left)
            begins.add(right)
            self.gone[best[0]] = self.count.pop(best[0])
        return out


@contextmanager
def _as_planned(spark: SparkSession) -> Iterator[None]:
    """A round is one pass and one small sum: there is nothing to plan anew between
    them, and the sum needs few partitions."""
    width = "spark.sql.shuffle.partitions"
    round_conf = {"spark.sql.adaptive.enabled": "false", width: str(min(int(spark.conf.get(width)), ROUND_PARTITIONS))}
    before = {k: spark.conf.get(k) for k in round_conf}
    try:
        for k, v in round_conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _apart(guess: tuple, before: list[tuple]) -> bool:
    """May a guess be taken before others that its changes were counted after? Yes
    if it shares no inner symbol with them and stood beside none of their
    occurrences (no changed pair holds their token): then the changes of each
    are the same in both orders."""
    _, left, right, _, step = guess
    if any(left == b_right or right == b_left for _, b_left, b_right, _, _ in before):
        return False
    new = {b_new for _, _, _, b_new, _ in before}
    return not any((key >> _BITS) in new or (key & _LOW) in new for key, _ in step)


def learn_merges(spark: SparkSession, histogram: DataFrame, tokens: list[str], token_id: dict[str, int], vocab_size: int, *, min_frequency: int = 0,
                 tracked: int = 50_000, rewrite_after: int = 256, most_guesses: int = 64, stats: dict | None = None) -> list[tuple[str, str, str]]:
    """Merges in order; ``tokens`` and ``token_id`` grow with them. The driver
    holds at most 2 * ``tracked`` pairs and the vocabulary."""
    stats = {} if stats is None else stats
    stats.update(rounds=0, rewrites=0, recounts=0)
    path, blocks = _stored(make_blocks(histogram, token_id))
    ranking, merges = Ranking(tracked), []
    pending: list[Merge] = []     # accepted, not in the written blocks yet
    unresolved: list[Merge] = []  # accepted, their changes are not known yet
    least, size, fresh = max(min_frequency, 1), 16, False
    room = min(32, rewrite_after)  # the first merges are the ones with the most places

    def accepted(left: int, right: int) -> None:
        merges.append((tokens[left], tokens[right], tokens[left] + tokens[right]))

    try:
        while len(tokens) < vocab_size:
            best = None if unresolved else ranking.best()
            if pending and (len(pending) >= room or best is None and not unresolved):
                room = min(2 * room, rewrite_after)
                new_path, new_blocks = _stored(_rewritten(blocks, pending))
                _dropped(path, blocks)
                path, blocks, pending = new_path, new_blocks, []
                stats["rewrites"] += 1
            if not unresolved:
                if best is None and fresh:
                    break  # no pair is left
                if best is None:
                    top = _all_pairs(blocks).orderBy(F.desc("cnt"), "key").limit(tracked + 1).collect()
                    ranking.reset([(r["key"], r["cnt"]) for r in top])
                    fresh = True
                    stats["recounts"] += 1
                    continue
                if best[1] < least:
                    break
            guesses, made = [], {}
            for left, right in ranking.guesses(min(size, vocab_size - len(tokens)), unresolved):
                string = tokens[left] + tokens[right]
                known = string in token_id or string in made
                if known and (guesses or unresolved):
                    break
                made[string] = token_id.get(string, len(tokens) + len(made))
                guesses.append((left, right, made[string]))
                if known:
                    break
            steps = unresolved + guesses
            keys = np.sort(np.fromiter(ranking.count, np.int64, len(ranking.count)))
            changes: list[list[tuple[int, int]]] = [[] for _ in steps]
            with _as_planned(spark):
                got = _round(blocks, pending, steps, keys, ranking.least()).toArrow()
            for step, key, by in zip(*(c.to_pylist() for c in got.select(["step", "key", "change"]).columns)):
                changes[step].append((key, by))
            stats["rounds"] += 1
            fresh = False
            for step in changes[:len(unresolved)]:
                for key, by in step:
                    ranking.change(key, by)
            pending += unresolved
            ranking.gone.clear()
            held, again = 0, False
            real: dict[int, int] = {}  # guessed id -> id
            left_over = [(k, *m, changes[len(unresolved) + k]) for k, m in enumerate(guesses)]
            while left_over:
                best = ranking.best()
                at = next((i for i, g in enumerate(left_over) if best and best[0] == pair_key(g[1], g[2])), None)
                if at is None or best[1] < least or len(tokens) >= vocab_size or not _apart(left_over[at], left_over[:at]):
                    break
                _, left, right, new, step = left_over.pop(at)
                held += 1
                string = tokens[left] + tokens[right]
                again = string in token_id
                real[new] = token_id[string] if again else len(tokens)
                if not again:
                    token_id[string] = len(tokens)
                    tokens.append(string)
                accepted(left, right)
                pending.append((left, right, real[new]))
                for key, by in step:
                    key_left, key_right = key >> _BITS, key & _LOW
                    ranking.change(pair_key(real.get(key_left, key_left), real.get(key_right, key_right)), by)
            if again:  # pairs of an old token may have gained: all are counted
                ranking, unresolved = Ranking(tracked), []
                continue
            size = min(2 * size, most_guesses) if held == len(guesses) else max(2 * held, 16)
            ranking.trim()
            unresolved = ranking.certain(tokens, token_id, vocab_size, least)
            for left, right, _ in unresolved:
                accepted(left, right)
    finally:
        _dropped(path, blocks)
    return merges
