"""SentencePiece (merge type) encoding and decoding.

The encoder never runs merges over the text. For every prefix of a unit of
text it stores the one piece that ends it: an Aho-Corasick automaton over the
pieces reports every piece that ends at a position, and the one that is
compatible with the piece stored for the prefix before it is the answer
(two pieces are compatible when merging their joined characters gives back
just these two; a merge encoding is valid exactly when all neighbours are).
The ids are then read backwards from the end.

No piece of a merge model that splits on white space holds a character
followed by the space mark, so a text falls into independent units
"marks + characters"; a bounded cache keeps the units' ids per task. The
property is checked when the model is loaded; without it the whole text is
one unit.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # piece types of the model format

OUT = "ids array<int>, decoded string"
DIGEST = "n_tokens long, ids_sha256 string, decoded_sha256 string"


class PieceTable:
    """Pieces of one merge-type model and the tests between them."""

    def __init__(self, model_bytes: bytes):
        import ahocorasick
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        m.ParseFromString(model_bytes)
        n = m.normalizer_spec
        if m.trainer_spec.model_type != 2 or n.precompiled_charsmap or n.remove_extra_whitespaces or not n.escape_whitespaces \
                or m.trainer_spec.treat_whitespace_as_suffix or any(p.type in (USER, UNUSED) for p in m.pieces):
            raise ValueError("a merge-type model with identity normalisation is needed")
        self.library = SentencePieceProcessor(model_proto=model_bytes)
        self.dummy_prefix = n.add_dummy_prefix
        self.score = {p.piece: p.score for p in m.pieces if p.type == NORMAL}
        self.id = {p.piece: i for i, p in enumerate(m.pieces) if p.type == NORMAL}
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(m.pieces) if p.type == BYTE}
        self.unk = next(i for i, p in enumerate(m.pieces) if p.type == UNKNOWN)
        self.split = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.id)
        self.halves: dict[str, tuple[str, str]] = {}  # what a piece is last merged from
        self.automaton = ahocorasick.Automaton()
        self.piece = [p.piece for p in m.pieces]
        for p, i in self.id.items():
            if self.merged(p) == [p]:  # a piece that its own characters do not merge to never appears
                self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.right_side = {p: self._side(p, 1) for p in self.id}
        self.left_side = {p: self._side(p, 0) for p in self.id}
        self.known = {p for p in self.id if len(p) == 1}
        self._fits: list[dict[int, bool]] = [{} for _ in m.pieces]
        self._room = 1_000_000

    def _side(self, piece: str, at: int) -> list[tuple[str, float]]:
        """The symbols that stand at one end of a piece while it is merged, each
        with the score of the merge that takes it up (the piece itself: none)."""
        out, end = [(piece, float("-inf"))], piece
        while end in self.halves:
            taken = self.score[end]
            end = self.halves[end][at]
            out.append((end, taken))
        return out

    def merged(self, s: str) -> list[str]:
        """Plain merging, for strings as short as a piece or two: best score
        first, leftmost among equals."""
        sym: list[str | None] = list(s)
        nxt = list(range(1, len(sym) + 1))
        prv = list(range(-1, len(sym) - 1))
        heap: list[tuple[float, int, str]] = []

        def push(i: int) -> None:
            j = nxt[i]
            if j < len(sym) and (sc := self.score.get(sym[i] + sym[j])) is not None:
                heapq.heappush(heap, (-sc, i, sym[i] + sym[j]))

        for i in range(len(sym) - 1):
            push(i)
        while heap:
            _, i, both = heapq.heappop(heap)
            j = nxt[i]
            if sym[i] is None or j >= len(sym) or sym[i] + sym[j] != both:
                continue
            self.halves.setdefault(both, (sym[i], sym[j]))
            sym[i], sym[j], nxt[i] = both, None, nxt[j]
            if nxt[i] < len(sym):
                prv[nxt[i]] = i
            push(i)
            if prv[i] >= 0:
                push(prv[i])
        return [x for x in sym if x is not None]

    def fits(self, left: int, right: int) -> bool:
        """May piece ``right`` follow piece ``left``? Answers are kept, a million at most."""
        if self._room == 0:
            for d in self._fits:
                d.clear()
            self._room = 1_000_000
        self._room -= 1
        ok = self._fits[left][right] = self._compatible(self.piece[left], self.piece[right])
        return ok

    def _compatible(self, left: str, right: str) -> bool:
        """No merge crosses the border: a crossing merge of two end symbols
        would have to come before the merges that take these up inside their
        own pieces (of equals, the one further left comes first)."""
        if left[-1] == SPACE and right[0] == SPACE:  # runs of marks share one score
            return self.merged(left + right) == [left, right]
        score = self.score.get
        for x, taken_x in self.right_side[left]:
            for y, taken_y in self.left_side[right]:
                both = score(x + y)
                if both is not None and both > taken_x and both >= taken_y:
                    return False
        return True

    def run_ids(self, run: str) -> list[int]:
        """The ids of a run of known characters, through the prefix table."""
        fits = self._fits
        last = [-1] * (len(run) + 1)  # by prefix length: the id of the piece that ends it
        size = [0] * (len(run) + 1)
        for end, (piece, n) in self.automaton.iter(run):
            end += 1
            if last[end] < 0:
                start = end - n
                if start:
                    before = last[start]
                    if before < 0:
                        continue
                    ok = fits[before].get(piece)
                    if ok is None:
                        ok = self.fits(before, piece)
                    if not ok:
                        continue
                last[end] = piece
                size[end] = n
        out, end = [], len(run)
        while end:
            out.append(last[end])
            end -= size[end]
        out.reverse()
        return out

    def unit_ids(self, unit: str) -> tuple[int, ...]:
        """Ids of a unit. A character outside the vocabulary stands alone:
        nothing merges with it, and it is written as bytes."""
        if self.known.issuperset(unit):
            return tuple(self.run_ids(unit))
        ids: list[int] = []
        lo = 0
        for i, ch in enumerate(unit):
            if ch not in self.known:
                if lo < i:
                    ids += self.run_ids(unit[lo:i])
                ids += [self.byte[b] for b in ch.encode("utf-8")] if self.byte else [self.unk]
                lo = i + 1
        if lo < len(unit):
            ids += self.run_ids(unit[lo:])
        return tuple(ids)


class UnitCache(dict):
    """Unit -> ids in two generations of at most ``most`` units each: when the
    younger is full it becomes the older, which is forgotten; a unit found in
    the older one is young again."""

    def __init__(self, table: PieceTable, most: int):
        super().__init__()
        self.table, self.most, self.older = table, most, {}

    def __missing__(self, unit: str) -> tuple[int, ...]:
        ids = self.older.get(unit)
        if ids is None:
            ids = self.table.unit_ids(unit)
        if len(unit) <= 64:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[unit] = ids
        return ids


def encode_text(table: PieceTable, cache: UnitCache, text: str) -> list[int]:
    """Ids of one text, equal to the library's."""
    if not text:
        return []
    s = text.replace(" ", SPACE)
    if table.dummy_prefix:
        s = SPACE + s
    if not table.split:
        return list(table.unit_ids(s))
    if SPACE + SPACE in s or s[0] != SPACE:
        units: Iterator[str] = iter(re.findall(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", s))
    else:
        units = (SPACE + u for u in s[1:].split(SPACE))
    out: list[int] = []
    for ids in map(cache.__getitem__, units):
        out += ids
    return out


_LOADED: dict[tuple[bytes, int], tuple[PieceTable, UnitCache]] = {}


def _loaded(model_bytes: bytes, cache_units: int) -> tuple[PieceTable, UnitCache]:
    """Table and cache of this Python worker, kept from task to task."""
    key = (hashlib.sha256(model_bytes).digest(), cache_units)
    if key not in _LOADED:
        table = PieceTable(model_bytes)
        _LOADED[key] = (table, UnitCache(table, cache_units))
    return _LOADED[key]


def _coder(model_bytes: bytes, cache_units: int, digest: bool):
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, cache = _loaded(model_bytes, cache_units)
        decode = table.library.decode
        for batch in batches:
            texts = batch.column(0)
            for lo in range(0, len(texts), 256):
                rows = []
                for text in texts.slice(lo, 256):
                    ids = encode_text(table, cache, text.as_py() or "")
                    back = decode(ids) if ids else ""
                    if digest:
                        rows.append((len(ids), hashlib.sha256(str(ids)[1:-1].replace(" ", "").encode()).hexdigest(),
                                     hashlib.sha256(back.encode("utf-8")).hexdigest()))
                    else:
                        rows.append((ids, back))
                kinds = [pa.int64(), pa.string(), pa.string()] if digest else [pa.list_(pa.int32()), pa.string()]
                names = ["n_tokens", "ids_sha256", "decoded_sha256"] if digest else ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, 256) for c in batch.columns[1:]),
                                                  *(pa.array(list(c), k) for c, k in zip(zip(*rows), kinds))],
                                                 names=[*batch.schema.names[1:], *names])
        cache.older = {}  # other tasks of this worker may need the memory
    return code


def model_bytes(path: str) -> bytes:
    """A tokenizer file (about 0.5 MB); it travels inside the task closure,
    so executors need no file of their own."""
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model: str, *, cache_units: int = 200_000, digest: bool = False, keep: list[str] | None = None) -> DataFrame:
    """Encode and decode every whole ``text`` of ``docs`` with the model file.

    Returns doc_id, the columns ``keep``, ids and decoded (or with ``digest``
    their SHA-256 digests and the id count). One row per input row: repeated
    rows and null ids give one row each; null and empty texts have no ids and
    decode to the empty string; other columns are ignored. Narrow: no shuffle.
    """
    rows = docs.select(F.col("text").cast("string").alias("_text"), F.col("doc_id").cast("long").alias("doc_id"), *(keep or []))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(_coder(model_bytes(model), cache_units, digest), f"{schema}, {DIGEST if digest else OUT}")
