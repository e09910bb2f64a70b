"""Words that a polynomial modulo 2**64 takes for one another."""
import sys
import tracemalloc

import numpy as np

sys.path.insert(0, __file__.rsplit("/", 1)[0])
import brute  # noqa: E402
from test_llm import same  # noqa: E402

from ledgerloom.llm import common, near_dedup, quality_model, substring_dedup  # noqa: E402


def thue_morse(n):
    """Two words of 2**n letters whose polynomials agree modulo 2**64 for every odd base, from n = 10 or 11 on."""
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


def test_long_words_of_two_letters(spark):
    for n in (6, 11):
        a, b = thue_morse(n)
        rows = [(1, a), (2, b), (3, a + b), (4, b + a), (5, a)]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        same(near_dedup.near_duplicates(docs, shingle=2).select("doc_id", "n_shingles", "component_id").collect(), brute.near(rows, 2))
        more = " ".join(f"w{k}" for k in range(49))
        rows = [(1, f"{a} {more}"), (2, f"{b} {more}"), (3, f"{a} {more} end")]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        same(substring_dedup.remove_repeats(docs, width=50, digest=True).collect(), brute.word_passages(rows))


def _hashed(text):
    data = np.frombuffer(text, np.uint8)
    starts, ends, _ = common.word_spans(data, np.array([0, len(data)]))
    return common.word_hashes(data, starts, ends)


def test_word_hashes_by_stretches(monkeypatch):
    r = np.random.default_rng(3)
    words = [bytes(r.integers(97, 123, int(n), dtype=np.uint8)) for n in r.choice([1, 3, 8, 31, 32, 33, 200], 3000)]
    words += words[:500]
    text = b" ".join(words)
    whole = _hashed(text)
    assert len(whole) == len(words) and len(set(whole.tolist())) == len(set(words))
    for size in (1, 7, 40, 1000):
        monkeypatch.setattr(common, "STRETCH", size)
        assert (_hashed(text) == whole).all()
    assert len(_hashed(b"")) == len(_hashed(b" \n ")) == 0


def test_long_text_memory():
    """The running sums of a long text are bounded; a word of a whole text too."""
    for text, bound in ((b"some words " * 4_000_000, 4), (b"x" * 40_000_000, 0.5)):
        data = np.frombuffer(text, np.uint8)
        starts, ends, _ = common.word_spans(data, np.array([0, len(data)]))
        tracemalloc.start()
        common.word_hashes(data, starts, ends)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < bound * len(text) + 60e6
    assert all(len(p) <= common._POW_KEPT for p in common._POW.values())


def test_texts_longer_than_the_blocks(spark, monkeypatch):
    """Texts over the block size of operators 1, 2 and 6 (one alone, one between short ones)."""
    r = np.random.default_rng(5)
    vocabulary = [f"w{k}" for k in range(5000)]
    long = " ".join(vocabulary[k] for k in r.integers(0, 5000, 400_000))  # over 2 MB
    rows = [(1, "a b"), (2, long), (3, "c"), (4, long + " end"), (5, long[:1_000_000])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    same(near_dedup.near_duplicates(docs, shingle=2).select("doc_id", "n_shingles", "component_id").collect(), brute.near(rows, 2))
    same(substring_dedup.remove_repeats(docs, width=50, digest=True).collect(), brute.word_passages(rows))
    labels = spark.createDataFrame([(d, d % 2) for d, _ in rows], "doc_id long, quality int")
    assert quality_model.score(docs, labels, threshold=0.3).where("score between 0 and 1").count() == 5
