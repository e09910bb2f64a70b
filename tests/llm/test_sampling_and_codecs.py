"""Operators 11, 12 and 13 against plain Python, the library and exact round trips."""
import hashlib
import math
import random
import sys
import zlib
from collections import Counter

import numpy as np
import pytest

sys.path.insert(0, __file__.rsplit("/", 1)[0])
import brute  # noqa: E402
from test_llm import SF, pairs, same, table_rows  # noqa: E402

from ledgerloom.llm import fill_middle, importance, queries, word_codec  # noqa: E402

VOCABULARY = "word_bpe_49k.json"

# ------------------------------------------------------------------ 11


def _features(text):
    w = brute.ITEM_WORD.findall((text or "").translate(brute.LOW))
    return len(w), [zlib.crc32(" ".join(w[i:i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def _resampled(rows, items):
    """[(doc_id, n_features, weight, score, rank)]"""
    found = [(d, *_features(t)) for d, t in rows]
    s, t = Counter(b for _, _, f in found for b in f), Counter(b for _, x in items for b in _features(x)[1])
    big_s, big_t = float(s.total()) + 10000, float(t.total()) + 10000
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * big_s / ((s[b] + 1.0) * big_t))) for b in s}
    made = []
    for d, n, f in found:
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in f)
        made.append([d, n, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((x for x in made if x[1] >= 20), key=lambda x: (-x[4], x[0] is None, x[0] or 0, x[2]))
    drawn = len(able) * 5 // 100
    ranks = {id(x): k + 1 for k, x in enumerate(able[:drawn])}
    return [(d, n, w, sc, ranks.get(id(x))) for x in made for d, _, n, w, sc in [x]]


def test_resample(spark, docs, rows, none):
    items = [(1, "Alpha beta"), (2, None), (None, rows[0][1] or "x y z"), (3, "")]
    target = spark.createDataFrame(items, "item_id long, text string")
    got = importance.resample(docs, target)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    same(got.collect(), _resampled(pairs(rows), items))
    empty = spark.createDataFrame([], "item_id long, text string")
    same(importance.resample(docs, empty).collect(), _resampled(pairs(rows), []))
    assert importance.resample(none, target).collect() == []


def test_resample_table(spark):
    got = queries.op11_importance_resample(spark, SF).collect()
    same(got, _resampled(table_rows("documents", "doc_id, text"), table_rows("benchmark", "item_id, text")))
    ranks = sorted(r["rank"] for r in got if r["rank"] is not None)
    assert ranks == list(range(1, len(ranks) + 1)) and ranks


def test_resample_ties(spark):
    """One text under many ids, one id under many rows, and no id at all."""
    text = " ".join(f"w{k}" for k in range(25))
    made = [(7, text)] * 60 + [(None, text)] * 60 + [(k, text) for k in range(100, 160)] + [(k, "too short") for k in range(30)]
    target = spark.createDataFrame([(1, "w1 w2 w3")], "item_id long, text string")
    got = importance.resample(spark.createDataFrame(made, "doc_id long, text string").repartition(7), target).collect()
    same(got, _resampled(made, [(1, "w1 w2 w3")]))


def test_draw_prefers_the_target(spark):
    r = random.Random(2)
    like, other = [f"t{k}" for k in range(50)], [f"o{k}" for k in range(50)]
    made = [(k, " ".join(r.choice(like if k % 10 == 0 else other) for _ in range(60)), "x") for k in range(400)]
    target = spark.createDataFrame([(1, " ".join(r.choice(like) for _ in range(3000)))], "item_id long, text string")
    got = importance.draw(spark.createDataFrame(made, "doc_id long, text string, rank string"), target, percent=10)
    assert got.columns == ["doc_id", "text", "rank"]
    ids = [x["doc_id"] for x in got.collect()]
    assert len(ids) == 40 and all(i % 10 == 0 for i in ids)


def test_features_of_long_texts(monkeypatch):
    texts = ["", "Aé ÜX _ \x00y", "x" * 300 + " " + "é" * 40 + " z", "ä" * 65, " ".join(f"W{k}é" for k in range(3000)), "\x7f", "漢字 " * 100]
    raw = [t.encode() for t in texts]
    data, offs = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    for stretch in (1 << 20, 64, 5):
        monkeypatch.setattr(importance, "STRETCH", stretch)
        words, total, out = importance._features(data, offs, importance._splitter(), 3, 10000)
        ends = np.cumsum(total)
        for k, t in enumerate(texts):
            assert (words[k], Counter(out[ends[k] - total[k]:ends[k]].tolist())) == (_features(t)[0], Counter(_features(t)[1]))


def test_crcs():
    r = random.Random(6)
    data = r.randbytes(5000)
    spans = [(a, a + r.choice([0, 1, 5, 63, 64, 65, 900])) for a in (r.randrange(4000) for _ in range(400))]
    a, b = (np.array(x) for x in zip(*spans))
    crc = importance.span_crcs(np.frombuffer(data, np.uint8), a, b)
    assert crc.tolist() == [zlib.crc32(data[x:y]) for x, y in spans]
    both = importance.crc_shift(crc[:-1], (b - a)[1:]) ^ crc[1:]
    assert both.tolist() == [zlib.crc32(data[x:y] + data[u:v]) for (x, y), (u, v) in zip(spans, spans[1:])]


# ------------------------------------------------------------------ 12

@pytest.fixture(scope="module")
def table():
    with open(queries.tokenizer_file(VOCABULARY), "rb") as f:
        return word_codec.WordTable(f.read())


def _library(table, text):
    ids = table.library.encode(text, add_special_tokens=False).ids
    return ids, table.library.decode(ids, skip_special_tokens=False)


def _ours(table, cache, text):
    parts = list(word_codec.encoded(table, cache, text))
    return np.frombuffer(b"".join(a for a, _ in parts), "<u4").tolist(), " ".join(b for _, b in parts)


def test_word_codec(docs, rows, table, none):
    out = word_codec.encode(docs, queries.tokenizer_file(VOCABULARY), digest=True)
    want = [(i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), brute.sha(back))
            for i, t in pairs(rows) for ids, back in [_library(table, t or "")]]
    same(out.collect(), want)
    plain = word_codec.encode(docs, queries.tokenizer_file(VOCABULARY), keep=["class", "n"])
    assert plain.columns == ["doc_id", "class", "n", "ids", "decoded"]
    same([(r["doc_id"], list(r["ids"]), r["decoded"]) for r in plain.collect()], [(i, *_library(table, t or "")) for i, t in pairs(rows)])
    assert word_codec.encode(none, queries.tokenizer_file(VOCABULARY)).collect() == []


def test_word_codec_table(spark, table):
    want = [(i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), brute.sha(back))
            for i, t in table_rows("documents", "doc_id, text") for ids, back in [_library(table, t or "")]]
    same(queries.op12_word_codec(spark, SF).collect(), want)


def test_word_codec_random(table, monkeypatch):
    r = random.Random(3)
    pool = "aAbBzZ019 '\"!?.,\t\n\r 　\x1c\x1f\x85\x00éÉéßİıΣσςǅ̧각가가漢字😀‍​﻿½²Ⅷ٣।काཱﬁÅÅ _-<|>"
    marks = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext", "'s", "'LL", " don't", "'street", "!'s"]
    cache = word_codec.WordCache(table, 50)
    texts = ["".join(r.choice(marks) if r.random() < 0.1 else r.choice(pool) for _ in range(r.randint(0, 40))) for _ in range(3000)]
    texts += ["".join(chr(r.choice([r.randint(0, 0x2FF), r.randint(0, 0xD7FF), r.randint(0x10000, 0x1FFFF)])) for _ in range(r.randint(0, 12))) for _ in range(1500)]
    for t in texts:
        assert _ours(table, cache, t) == _library(table, t), repr(t)
    assert len(cache) <= 50
    monkeypatch.setattr(word_codec, "STRETCH", 3)
    for t in texts[:1500] + [" ".join(texts[:300])]:
        assert _ours(table, cache, t) == _library(table, t), repr(t)


def test_forced_boundaries(table):
    """No token of the vocabulary spans a cut, and some words are cut."""
    tokens = [t.removesuffix(word_codec.END) for t in table.id]
    cut = [f for f in map(table.fragments, ["qxzqj", "thereé", "ĠĠ", "qwzxvk"]) if len(f) > 1]
    assert cut
    for f in cut:
        for a, b in zip(f, f[1:]):
            assert not any(a[-1] + b[0] in t for t in tokens)


def test_long_word(table):
    word = "z" * 50000 + "é" * 20000
    assert _ours(table, word_codec.WordCache(table, 5), word) == _library(table, word)


# ------------------------------------------------------------------ 13

def _middle(doc_id, text):
    text = text or ""
    hexes = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(hexes[k:k + 8], 16) for k in (0, 8, 16, 24)]
    n = len(text)
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    a, b = min(h[0] % (n + 1), h[1] % (n + 1)), max(h[0] % (n + 1), h[1] % (n + 1))
    if h[3] % 100 < 20:
        return doc_id, n, "spm", a, b - a, "<S>" + text[b:] + "<P>" + text[:a] + "<M>" + text[a:b]
    return doc_id, n, "psm", a, b - a, "<P>" + text[:a] + "<S>" + text[b:] + "<M>" + text[a:b]


def test_fill_in_middle(spark, docs, rows, none):
    odd = [(k, t) for k, t in enumerate(["a<P>b", "<S>", "x<M", "<P", "<<S", "S>" * 50, "<M><", "é‍😀\x00\r\n"] * 30)]
    for made, frame in ((pairs(rows), docs), (odd, spark.createDataFrame(odd, "doc_id long, text string"))):
        want = [_middle(i, t) for i, t in made]
        same(fill_middle.fill_in_middle(frame).collect(), [(*w, t or "") for w, (_, t) in zip(want, made)])
        same(fill_middle.fill_in_middle(frame, digest=True).collect(), [(*w[:5], brute.sha(w[5]), brute.sha(t or "")) for w, (_, t) in zip(want, made)])
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(none).collect() == []


def test_fill_in_middle_table(spark):
    rows = table_rows("documents", "doc_id, text")
    same(queries.op13_fill_middle(spark, SF).collect(), [(*_middle(i, t)[:5], brute.sha(_middle(i, t)[5]), brute.sha(t or "")) for i, t in rows])


def test_units_of_long_texts(monkeypatch):
    text = "".join(random.Random(1).choice("aé😀\n") for _ in range(fill_middle.BLOCK * 2 + 77))
    cuts = fill_middle.Units()(text)
    assert cuts.n == len(text) and not cuts.ends
    for k in (0, 1, fill_middle.RUN, fill_middle.RUN + 1, 2 * fill_middle.RUN, len(text) - 1, len(text)):
        assert cuts.offset(k) == k
    monkeypatch.setattr(fill_middle, "BLOCK", 10)
    monkeypatch.setattr(fill_middle, "RUN", 3)
    words = "one  two three\n four five  six seven "
    cuts = fill_middle.Units(r"\S+\s*|\s+")(words)
    assert cuts.n == 7 and [words[cuts.offset(k):cuts.offset(k + 1)].strip() for k in range(7)] == words.split()
    for i, t in [(i, words[:k]) for i in range(8) for k in range(len(words))]:
        assert fill_middle.transform(fill_middle.Units(), t, i) == _middle(i, t)[1:]
