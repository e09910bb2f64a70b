"""Encoding and decoding with a word-end BPE vocabulary of the tokenizers library.

Forced-boundary splitting: a merge joins two neighbouring symbols into a
token of the vocabulary, so no merge ever spans two bytes that are neighbours
in none of its tokens. Such byte pairs are certain cuts; the fragments between
them are encoded independently and their ids concatenated. The ends of the
vocabulary's words (a pre-token's last byte carries the end mark) are cuts too.

Before that a text takes the library's own steps: strings of added tokens are
found in the raw text, what is between them is normalised and pre-tokenized.
Where all characters of a text are ones on which Python and the library agree
(tested once per character and worker) the normal form and the pre-tokens
come from Python's faster functions, else from the library.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

END = "</w>"
#: What the vocabulary file must say; fixed values, in the file's own words.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
STRETCH = 1 << 20  # characters encoded at a time
_SAFE = re.compile(r"(?<= )(?=[A-Za-z0-9])")  # nothing below joins what is left and right of such a place

OUT = "ids array<int>, decoded string"
DIGEST = "n_tokens long, ids_sha256 string, decoded_sha256 string"


class WordTable:
    """Vocabulary, merges, forced boundaries and the steps before them."""

    def __init__(self, data: bytes):
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        spec = json.loads(data)
        model, added, steps = spec["model"], spec["added_tokens"], spec["pre_tokenizer"].get("pretokenizers", [])
        split = steps[0] if len(steps) == 2 else {}
        if model["type"] != "BPE" or model["end_of_word_suffix"] != END or model["dropout"] or model["unk_token"] or model["continuing_subword_prefix"] \
                or model["byte_fallback"] or model["ignore_merges"] or spec["decoder"] or spec["normalizer"] != NORMALIZER \
                or split.get("type") != "Split" or split["behavior"] != "Removed" or not split["invert"] or steps[1]["type"] != "ByteLevel" \
                or steps[1]["use_regex"] or steps[1]["add_prefix_space"] or any(a["normalized"] or a["lstrip"] or a["rstrip"] or a["single_word"] for a in added):
            raise ValueError("a byte-level BPE with word ends over lower-cased NFC text is needed")
        self.library = Tokenizer.from_str(data.decode("utf-8"))
        self.byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.spelling: dict[str, str] = {}
        pattern = split["pattern"]["Regex"]
        self.words = regex.compile(pattern).findall
        self.ascii_words = self.words
        plain = pattern.replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9").replace(r"\s", " \\t\\n\\v\\f\\r")
        if "\\p" not in plain:  # the same classes among ASCII characters, for Python's faster matcher
            faster, chars = re.compile(plain).findall, [chr(c) for c in range(128)]
            if all(faster(t) == self.words(t) for t in [f"a{x}{y}1'{x}" for x in chars for y in chars]):
                self.ascii_words = faster
        self.id = model["vocab"]
        self.added = {a["content"]: a["id"] for a in added}
        self.specials = re.compile("|".join(re.escape(a) for a in sorted(self.added, key=len, reverse=True))) if added else None
        self.rank = {tuple(m if isinstance(m, list) else m.split(" ")): k for k, m in enumerate(model["merges"])}
        self.inside = {p[k:k + 2] for p in (t.removesuffix(END) for t in self.id) for k in range(len(p) - 1)}
        self.agreed: set[str] = set()
        self.doubted: set[str] = set()

    # ------------------------------------------------------------ before the merges

    def _agree(self, ch: str) -> bool:
        """Do Python and the library treat a character alike? Unassigned characters,
        marks and what composes with its neighbours or lowers by context do not count."""
        kind = unicodedata.category(ch)
        if kind in ("Cn", "Mn", "Mc", "Me") or "ᄀ" <= ch <= "ᇿ" or ch == "Σ" or unicodedata.combining(ch) or len(ch.lower()) != 1:
            return False
        low = ch.lower()
        plain = " " if kind in ("Zs", "Zl", "Zp") or ch in "\t\n\v\f\r\x85" else low
        if self.library.normalizer.normalize_str(ch) != plain or unicodedata.normalize("NFC", ch) != ch:
            return False
        text = f"a{plain}1{plain}{plain}!"
        got = [t for t, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]
        return got == [self.as_bytes(w) for w in self.words(text)]

    def pre_tokens(self, text: str) -> list[str]:
        """The pre-tokens of a stretch without added tokens, as plain text."""
        if not text.isascii():
            new = set(text) - self.agreed
            for ch in new:
                if ch not in self.doubted:
                    (self.agreed if self._agree(ch) else self.doubted).add(ch)
            if not new.isdisjoint(self.doubted) or not unicodedata.is_normalized("NFC", text):
                norm = self.library.normalizer.normalize_str(text)
                return [norm[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(norm)]
            return self.words(text.lower())
        return self.ascii_words(text.lower())

    def stretches(self, text: str) -> Iterator[tuple[bool, str]]:
        """(is it an added token, text) from left to right; what is between added
        tokens comes in pieces of about ``STRETCH`` characters, cut between a
        space and a letter or digit where there is such a place."""
        at = 0
        for found in [*(self.specials.finditer(text) if self.specials else ()), None]:
            end = found.start() if found else len(text)
            while at < end:
                safe = _SAFE.search(text, at + STRETCH, end) if end - at > STRETCH else None
                upto = safe.start() if safe else end
                yield False, text[at:upto]
                at = upto
            if found:
                yield True, found.group()
                at = found.end()

    # ------------------------------------------------------------ merges

    def as_bytes(self, pre_token: str) -> str:
        """The library's spelling of a text's bytes, a character each; the spelling
        of each character is asked for once (there are at most 1.1 million)."""
        spelling = self.spelling
        try:
            return "".join([spelling[ch] for ch in pre_token])
        except KeyError:
            for ch in set(pre_token).difference(spelling):
                spelling[ch] = self.byte_level.pre_tokenize_str(ch)[0][0]
            return "".join([spelling[ch] for ch in pre_token])

    def fragments(self, word: str) -> list[str]:
        """A pre-token (one character a byte) cut at its forced boundaries."""
        pairs = list(map(str.__add__, word, word[1:]))
        if self.inside.issuperset(pairs):
            return [word]
        cuts = [0, *(k for k, pair in enumerate(pairs, 1) if pair not in self.inside), len(word)]
        return [word[a:b] for a, b in zip(cuts, cuts[1:])]

    def merged(self, sym: list[str]) -> list[str]:
        """Merges by rank, leftmost first, over the symbols of one fragment: the
        least rank of a short list is looked for anew, a long one has a heap."""
        if len(sym) > 100:
            return self._merged_long(sym)
        rank, none = self.rank.get, len(self.rank)
        ranks = [rank(pair, none) for pair in zip(sym, sym[1:])]
        while ranks:
            least = min(ranks)
            if least == none:
                break
            i = ranks.index(least)
            sym[i] += sym.pop(i + 1)
            del ranks[i]
            if i:
                ranks[i - 1] = rank((sym[i - 1], sym[i]), none)
            if i < len(ranks):
                ranks[i] = rank((sym[i], sym[i + 1]), none)
        return sym

    def _merged_long(self, sym: list[str]) -> list[str]:
        nxt, prv = list(range(1, len(sym) + 1)), list(range(-1, len(sym) - 1))
        heap: list[tuple[int, int, str, str]] = []

        def push(i: int) -> None:
            if i >= 0 and nxt[i] < len(sym):
                rank = self.rank.get((sym[i], sym[nxt[i]]))
                if rank is not None:
                    heapq.heappush(heap, (rank, i, sym[i], sym[nxt[i]]))

        for i in range(len(sym) - 1):
            push(i)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = nxt[i]
            if sym[i] != left or j >= len(sym) or sym[j] != right:
                continue
            sym[i], sym[j], nxt[i] = left + right, "", nxt[j]
            if nxt[i] < len(sym):
                prv[nxt[i]] = i
            push(i)
            push(prv[i])
        return [s for s in sym if s]

    def tokens(self, pre_token: str) -> list[str]:
        parts = self.fragments(self.as_bytes(pre_token))
        out: list[str] = []
        for k, part in enumerate(parts):
            sym = list(part)
            if k == len(parts) - 1:
                sym[-1] += END
            out += self.merged(sym)
        return out


class WordCache(dict):
    """Pre-token -> (ids as bytes, tokens joined by a space), in two generations
    of at most ``most`` pre-tokens of up to 64 characters."""

    def __init__(self, table: WordTable, most: int):
        super().__init__()
        self.table, self.most, self.older = table, most, {}

    def __missing__(self, word: str) -> tuple[bytes, str]:
        got = self.older.get(word)
        if got is None:
            tokens = self.table.tokens(word)
            got = b"".join(self.table.id[t].to_bytes(4, "little") for t in tokens), " ".join(tokens)
        if len(word) <= 64:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[word] = got
        return got


def encoded(table: WordTable, cache: WordCache, text: str) -> Iterator[tuple[bytes, str]]:
    """(ids, little-endian, four bytes each; decoded text) stretch by stretch;
    the decoded text is the stretches' joined by a space."""
    for special, part in table.stretches(text):
        if special:
            yield table.added[part].to_bytes(4, "little"), part
        else:
            got = [cache[w] for w in table.pre_tokens(part)]
            if got:
                yield b"".join([a for a, _ in got]), " ".join([b for _, b in got])


_LOADED: dict[tuple[bytes, int], tuple[WordTable, WordCache]] = {}


def _loaded(data: bytes, most: int) -> tuple[WordTable, WordCache]:
    """Table and cache of this Python worker, kept from task to task."""
    key = (hashlib.sha256(data).digest(), most)
    if key not in _LOADED:
        table = WordTable(data)
        _LOADED[key] = (table, WordCache(table, most))
    return _LOADED[key]


def _coder(data: bytes, most: int, digest: bool):
    def row(table: WordTable, cache: WordCache, text: str) -> tuple:
        if digest:
            size, ids, decoded = 0, hashlib.sha256(), hashlib.sha256()
            for a, b in encoded(table, cache, text):
                if size:
                    decoded.update(b" ")
                size += len(a) // 4
                ids.update(a)
                decoded.update(b.encode("utf-8"))
            return size, ids.hexdigest(), decoded.hexdigest()
        parts = list(encoded(table, cache, text))
        return memoryview(b"".join(a for a, _ in parts)).cast("I").tolist(), " ".join(b for _, b in parts)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, cache = _loaded(data, most)
        kinds = [pa.int64(), pa.string(), pa.string()] if digest else [pa.list_(pa.int32()), pa.string()]
        names = ["n_tokens", "ids_sha256", "decoded_sha256"] if digest else ["ids", "decoded"]
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                rows = [row(table, cache, text.as_py() or "") for text in part.column(0)]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *(pa.array(list(c), k) for c, k in zip(zip(*rows), kinds))],
                                                 names=[*part.schema.names[1:], *names])
        cache.older = {}  # other tasks of this worker may need the memory
    return code


def encode(docs: DataFrame, vocabulary: str, *, cache_words: int = 300_000, digest: bool = False, keep: list[str] | None = None) -> DataFrame:
    """Encode and decode every whole ``text`` of ``docs`` with the vocabulary file
    (about 2 MB, sent with the tasks), as the tokenizers library does without
    special tokens added; strings of added tokens in a text are those tokens.

    Returns doc_id, the columns ``keep``, ids and decoded (the tokens joined by
    a space), or with ``digest`` the id count and the SHA-256 of both. One row
    per input row: repeated rows and null ids give one row each; null and
    empty texts have no ids and decode to the empty string; other columns are
    ignored. Memory is bounded by the longest stretch of a text without a space
    before an ASCII letter or digit (and by ``STRETCH``). Narrow: no shuffle.
    """
    with open(vocabulary, "rb") as f:
        data = f.read()
    rows = docs.select(F.col("text").cast("string").alias("_text"), F.col("doc_id").cast("long").alias("doc_id"), *(keep or []))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(_coder(data, cache_words, digest), f"{schema}, {DIGEST if digest else OUT}")
