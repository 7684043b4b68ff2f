"""What Python workers hold from task to task and from step to step."""

import gc
import tracemalloc
import weakref

import numpy as np
import pyarrow as pa

from spanloom.llm import batches, bpe, neardup, toxicity


def test_a_worker_drops_what_it_kept_for_the_step_before(spark):
    vocab = bpe.vocabulary(spark)
    code = bpe.worker_encoder(vocab)
    assert bpe.worker_encoder(vocab) is code
    gone = weakref.ref(code)
    toxicity.grams(pa.array(["other work"]))
    del code
    gc.collect()
    assert gone() is None
    sampler = neardup.worker_sampler()
    assert neardup.worker_sampler() is sampler
    gone = weakref.ref(sampler)
    del sampler
    bpe.worker_encoder(vocab)
    gc.collect()
    assert gone() is None


def test_tables_of_samples_are_made_for_the_levels_met():
    tracemalloc.start()
    sampler = neardup.Sampler()
    level = np.array([0, 3, 0, 17])
    sampler.samples(np.arange(4, dtype=np.uint64) * np.uint64(1 << 50), level, np.array([0, 2, 4]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20  # addresses for all tables are 64 MB
    assert np.flatnonzero(sampler.filled).tolist() == [0, 3, 17]
    rng = np.random.default_rng(5)
    r, c, b = rng.gamma(2, 1, neardup.SLOTS), rng.gamma(2, 1, neardup.SLOTS), rng.random(neardup.SLOTS)
    sampler.fill(np.arange(neardup.LEVELS))
    t = np.floor(np.log(neardup.WEIGHTS)[:, None] / r + b)
    a = (c / np.exp(r * (t - b) + r)).astype(np.float32)
    want = (a.view(np.uint32).astype(np.uint64) << np.uint64(32)) | ((t.astype(np.int64).astype(np.uint64) & np.uint64(0xFF)) << np.uint64(24))
    assert (sampler.key == want.ravel()).all()


def test_long_texts_leave_no_tables_of_their_size_behind():
    text = np.frombuffer(b"word and word " * 160_000, np.uint8)
    starts, ends = np.array([0, 9, len(text) - 5]), np.array([4, 13, len(text) - 1])
    h = batches.span_hashes(text, starts, ends)
    assert h[0] == h[1] == h[2]
    assert len(batches._CACHE.get("up", ())) <= batches.POWERS + 1


def test_grams_of_some_texts_at_a_time(monkeypatch):
    texts = pa.array(["", "one two", None, "a", "one two one two", "é ñ 12", ""] + ["a rather long text " * 300] * 20)
    want = toxicity.grams(texts)
    monkeypatch.setattr(toxicity, "PIECE", 9)
    got = toxicity.grams(texts)
    assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(got, want, strict=True))
    assert all(len(x) == 0 for x in toxicity.grams(texts.slice(0, 0)))


def test_grams_take_few_times_their_text():
    texts = pa.array([f"text {i} of words " * 60 for i in range(2000)])
    tracemalloc.start()
    g, row = toxicity.grams(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(np.unique(row)) == 2000 and peak < 24 << 20
