"""BPE and token counts against the library, whole tables and odd texts."""

import hashlib
import random

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from spanloom.llm import bpe, tokencount
from spanloom.llm.queries import op8_bpe, op10_token_counts

LIBRARY = Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def vocab(spark):
    return bpe.vocabulary(spark)


def library_ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def test_query_is_the_library(spark, docs, small):
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = op8_bpe(spark, small).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library_ids(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(",".join(map(str, ids))))
        assert r.decoded_sha256 == sha(LIBRARY.decode(ids, skip_special_tokens=False))


def test_counts_are_the_library(spark, docs, small):
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in op10_token_counts(spark, small).collect():
        n = len(library_ids(texts[r.doc_id]))
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(texts[r.doc_id].encode()), n > 512)


def test_odd_texts(make, odd, vocab):
    rng = random.Random(3)
    noise = ["".join(rng.choice("ab '\n\t Zé1!　​\U0001f44d字\xa0") for _ in range(rng.randint(1, 60))) for _ in range(200)]
    texts = [*odd, *noise]
    df = make(texts, ids="clash", decoded=1)
    got = {r.doc_id: r for r in bpe.decode(bpe.encode(df, vocab), vocab).collect()}
    counts = {r.doc_id: r.n_tokens for r in tokencount.token_counts(df, vocab).collect()}
    for i, t in enumerate(texts):
        assert got[i].ids == library_ids(t), repr(t)[:80]
        assert got[i].decoded == LIBRARY.decode(library_ids(t), skip_special_tokens=False)
        assert counts[i] == len(library_ids(t))


def test_both_merges_agree(vocab):
    code = bpe.Encoder(vocab.value)
    rng = random.Random(5)
    for n in (2, 5, 40, 200):
        parts = [vocab.value.byte_ids[b] for b in "".join(rng.choice("theandio ") for _ in range(n)).encode()]
        assert bpe.merge_short(list(parts), code.v.merges) == bpe.merge_long(list(parts), code.v.merges)


def test_empty_table_and_repeats(make, vocab):
    assert bpe.digests(make(["a"]).where("false"), vocab).count() == 0
    assert tokencount.token_counts(make(["a"]).where("false"), vocab).count() == 0
    twice = make(["same text"]).unionByName(make(["same text"]))
    assert tokencount.token_counts(twice, vocab, sample_docs=1, entries=1).select("n_tokens").collect() == [(2,), (2,)]


def test_full_caches_keep_words_met_again(vocab, monkeypatch):
    rng = random.Random(7)
    text = " ".join("".join(rng.choice("abcé,'1") for _ in range(rng.randint(1, 7))) for _ in range(3000))
    monkeypatch.setattr(bpe, "CACHED", 40)
    monkeypatch.setattr(bpe, "PIECES", 10)
    code = bpe.Encoder(vocab.value)
    assert list(memoryview(code.text_ids(text)).cast("i")) == library_ids(text)
    assert len(code) <= 40 and len(code.old_words) == 40
    word = next(iter(code.old_words))
    monkeypatch.setattr(code, "encode", None)  # a word that was dropped is not encoded again
    assert code[word] == code.old_words[word]
