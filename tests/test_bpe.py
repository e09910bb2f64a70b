"""BPE training and encoding against the installed tokenizers library."""
import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import bpe as B

tokenizers = pytest.importorskip("tokenizers")


def _library(corpus, vocab_size, specials, unk=None):
    from tokenizers import Tokenizer, models, pre_tokenizers, trainers
    tok = Tokenizer(models.BPE(unk_token=unk) if unk else models.BPE())
    tok.pre_tokenizer = pre_tokenizers.Whitespace()
    tr = trainers.BpeTrainer(vocab_size=vocab_size, special_tokens=specials, show_progress=False)
    tok.train_from_iterator(corpus, trainer=tr)
    j = json.loads(tok.to_str())
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in j["model"]["merges"]]
    return tok, j["model"]["vocab"], merges


def _ours(spark, corpus, vocab_size, specials):
    df = spark.createDataFrame([(t,) for t in corpus], "text string")
    return B.train_bpe(spark, B.word_histogram(df, "text"), vocab_size, specials)


@pytest.mark.parametrize("corpus,vocab_size", [
    (["ab cd ef"], 100),                                  # ties: ab, cd, ef in order
    (["aaab", "aaab", "aaab"], 100),                      # overlapping pairs
    (["Netflix.com PG&E McDonald's", "Uber Trip", "Lyft Ride", "Uber Eats Uber"], 60),
    (["the cat sat on the mat", "the hat that the cat ate", "a a a a aa aaa"], 45),
])
def test_train_equals_library(spark, corpus, vocab_size):
    specials = ["[PAD]", "[UNK]", "[SEP]"]
    _tok, vocab, merges = _library(corpus, vocab_size, specials)
    m = _ours(spark, corpus, vocab_size, specials)
    assert {t: i for i, t in enumerate(m.tokens)} == vocab
    assert [(l, r) for l, r, _ in m.merges_list] == merges


def test_overlap_vocab(spark):
    m = _ours(spark, ["aaab"] * 3, 100, [])
    assert m.tokens == ["a", "b", "aa", "ab", "aaab"]


def test_train_on_documents_and_encode(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(40)
    corpus = [r.text for r in docs.collect()]
    specials = ["[PAD]", "[UNK]"]
    tok, vocab, merges = _library(corpus, 250, specials)
    m = _ours(spark, corpus, 250, specials)
    assert [(l, r) for l, r, _ in m.merges_list] == merges
    assert {t: i for i, t in enumerate(m.tokens)} == vocab
    df = spark.createDataFrame([(i, t) for i, t in enumerate(corpus[:10])], "k long, text string")
    enc = {r.k: (list(r.pieces), list(r.ids)) for r in B.encode_texts(df, ["k"], "text", m).collect()}
    for i, t in enumerate(corpus[:10]):
        e = tok.encode(t)
        assert enc[i] == (e.tokens, e.ids)


def test_unknown_characters_dropped_or_unk(spark):
    m = _ours(spark, ["ab ab ab"], 10, ["<UNK>"])
    df = spark.createDataFrame([(1, "abzz")], "k long, text string")
    drop = B.encode_texts(df, ["k"], "text", m).first()
    assert list(drop.pieces) == ["ab"]
    unk = B.encode_texts(df, ["k"], "text", m, unk="<UNK>").first()
    assert list(unk.pieces) == ["ab", "<UNK>", "<UNK>"]


def test_special_aware_split(spark):
    df = spark.createDataFrame([("<card> <OUTFLOW> Uber Trip [SEP]",)], "s string")
    plain = df.select(B.pretokenize("s")).first()[0]
    protected = df.select(B.pretokenize("s", ["<card>", "<OUTFLOW>", "[SEP]"])).first()[0]
    assert plain == ["<", "card", ">", "<", "OUTFLOW", ">", "Uber", "Trip", "[", "SEP", "]"]
    assert protected == ["<card>", "<OUTFLOW>", "Uber", "Trip", "[SEP]"]


def test_decode_loses_spaces(spark):
    m = _ours(spark, ["Uber Trip Uber Trip"], 40, [])
    df = spark.createDataFrame([(1, "Uber Trip")], "k long, text string")
    enc = B.encode_texts(df, ["k"], "text", m)
    assert enc.select(F.array_join("pieces", "")).first()[0] == "UberTrip"


def test_string_pipeline_tokenizers_equal_library(spark):
    from ledgerloom.operators import vocab as V
    from ledgerloom.plans import catalog as C
    sf = "/root/testdata/sf0.001"
    for corpus_df, col, specials, vs in [
        (C.tagged_corpus(spark, sf), "sequence", V.special_token_list("tagged"), 1000),
        (C.history_corpus(spark, sf), "transaction_history", V.special_token_list("spaced"), 10000),
    ]:
        assert corpus_df.agg(F.max("chunk")).first()[0] == 0  # whole strings at this scale
        corpus = [r[0] for r in corpus_df.select(col).collect()]
        _tok, vocab, merges = _library(corpus, vs, specials)
        m = B.train_bpe(spark, B.word_histogram(corpus_df, col), vs, specials)
        assert [(l, r) for l, r, _ in m.merges_list] == merges
        assert {t: i for i, t in enumerate(m.tokens)} == vocab


def test_chunked_histogram_equals_whole_text(spark):
    from collections import Counter
    import regex
    texts = {1: "<a><EOT><b>xy.z<EOT><c>", 2: "ab cd<EOT>ef", 3: "x"}
    rows = []
    for k, t in texts.items():
        cuts = [0, 3, 8, 9, len(t)] if k == 1 else [0, 2, 5, len(t)] if k == 2 else [0, 1]
        for c in range(len(cuts) - 1):
            rows.append((k, c, t[cuts[c]:cuts[c + 1]]))
    df = spark.createDataFrame(rows, "k long, chunk int, text string")
    got = {r.word: r.cnt for r in B.chunked_word_histogram(df, "k", "text").collect()}
    want = Counter(w for t in texts.values() for w in regex.findall(r"\w+|[^\w\s]+", t))
    assert got == dict(want)


def _whole_library(corpus, vocab_size, specials, unk=None):
    """The library's tokenizer with its special tokens recognised in texts."""
    from tokenizers import AddedToken
    tok, vocab, merges = _library(corpus, vocab_size, specials, unk)
    tok.add_special_tokens([AddedToken(s, special=True, normalized=False) for s in specials])
    return tok


def test_chunks_of_single_runs(spark):
    """Words that go on through any number of chunks, spaces between, empty chunks."""
    import itertools
    from collections import Counter
    import random
    import regex
    r, rows, want = random.Random(8), [], Counter()
    for k in range(60):
        text = "".join(r.choice("ab é!?  <") for _ in range(r.randint(0, 25)))
        want.update(regex.findall(r"\w+|[^\w\s]+", text))
        cuts = sorted(r.choices(range(len(text) + 1), k=r.randint(0, 9)))
        rows += [(k, c, text[a:b]) for c, (a, b) in enumerate(itertools.pairwise([0, *cuts, len(text)]))]
    df = spark.createDataFrame(rows, "k long, chunk int, text string")
    assert {x.word: x.cnt for x in B.chunked_word_histogram(df, "k", "text").collect()} == dict(want)


def test_specials_after_punctuation(spark):
    specials = ["<PAD>", "<SOS>", "<EOS>", "<EOT>", "<UNK>"]
    texts = ["yahoo!<EOT><in>x", "a (us)<EOT>b", "<day_week:sunday><EOT><out>", "[<SOS>]!!<EOS>", "<<EOT>>", "ab<EOTcd<EOT>"]
    tok = _whole_library(texts, 200, specials)
    m = _ours(spark, texts, 200, specials)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k long, text string")
    got = {r.k: list(r.ids) for r in B.encode_texts(df, ["k"], "text", m, specials).collect()}
    assert got == {i: tok.encode(t).ids for i, t in enumerate(texts)}


def test_string_pipelines_encode_like_the_library(spark):
    from ledgerloom.operators import vocab as V
    from ledgerloom.plans import catalog as C
    sf = "/root/testdata/sf0.001"
    for q, corpus, key, col, variant, size, unk in [
        (C.q_encode_history, C.history_corpus, "user_id", "transaction_history", "spaced", 10000, None),
        (C.q_encode_tagged, C.tagged_corpus, "client_id", "sequence", "tagged", 1000, "<UNK>"),
    ]:
        texts = {r[key]: r[col] for r in corpus(spark, sf).collect()}
        tok = _whole_library(list(texts.values()), size, V.special_token_list(variant), unk)
        got = {r[key]: r.ids for r in q(spark, sf).collect()}
        assert got == {k: ",".join(map(str, tok.encode(t).ids)) for k, t in texts.items()}


def test_user_sequences_equal_library(spark):
    """One pass over the users gives what encoding each transaction would."""
    from ledgerloom.functions import encode as E
    from ledgerloom.plans import catalog as C
    from ledgerloom.operators import vocab as V
    from ledgerloom.sources import tables as T
    sf = "/root/testdata/sf0.001"
    tx = T.transactions_from_events(spark, sf)
    specials = V.special_token_list("binned")
    rows = tx.where("user_id is not null").select("user_id", "date", "tx_id", "description", E.attribute_tokens("amount", "date").alias("a")).collect()
    tok, vocab, _ = _library([d for d in {r.description for r in rows} if d], 10000, specials)
    want = {}
    for r in sorted(rows, key=lambda r: (r.user_id, r.date, r.tx_id)):
        ids = [vocab[t] for t in r.a] + tok.encode(r.description or "").ids
        want[r.user_id] = want[r.user_id] + [vocab["[SEP]"]] + ids if r.user_id in want else ids
    got = {}
    for r in C.q_user_bpe(spark, sf).orderBy("user_id", "chunk").collect():
        got.setdefault(r.user_id, []).extend(map(int, r.ids.split(",")))
    assert got == want


def test_saved_tokenizer_encodes(spark, scratch):
    from ledgerloom.sources import io
    texts = ["the cat sat on the mat", "the hat that the cat ate [SEP]"]
    m = _ours(spark, texts, 45, ["[PAD]", "[SEP]"])
    io.write_vocabulary(m.vocab, m.merges, f"{scratch}/tok")
    again = B.load_bpe(spark, *io.read_vocabulary(spark, f"{scratch}/tok"))
    assert (again.tokens, again.specials, again.merges_list) == (m.tokens, m.specials, m.merges_list)
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None, ""])], "k long, text string")
    a, b = (sorted((r.k, r.ids) for r in B.encode_texts(df, ["k"], "text", x, ["[SEP]"]).collect()) for x in (m, again))
    assert a == b and a[2][1] == []
