"""Token counts by a map-side two-tier lookup.

First tier: a compact table (word -> token length) of frequent words, broadcast; it has at
most ``entries`` words of at most 64 characters, so its size is proven. It is filled from a
bounded sample of about ``sample_docs`` documents and sets speed only: a word that is not in
it is encoded by the worker and kept in the worker's cache, the second tier. No word is
ever shuffled.

Null and empty texts have 0 bytes and 0 tokens; repeated rows are counted each.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .batches import carried, prepare, slices, strings
from .bpe import CHUNK, Encoder, Shared

SAMPLE_BYTES = 1 << 16


class Lengths(dict):
    """First tier; a miss asks the second tier, which encodes and remembers."""

    def __init__(self, frequent: dict[str, int], encoder: Encoder) -> None:
        super().__init__(frequent)
        self.second = encoder

    def __missing__(self, word: str) -> int:
        return len(self.second[word]) // 4

    def count(self, text: str) -> int:
        code = self.second
        if code.cut is not None and any(s in text for s in code.v.special):
            return sum(1 if part in code.v.special else sum(map(self.__getitem__, CHUNK.findall(part))) for part in code.cut.split(text))
        return sum(map(self.__getitem__, CHUNK.findall(text)))


_LENGTHS: dict[int, Lengths] = {}


def frequent_lengths(docs: DataFrame, vocab: Shared, *, text: str = "text", sample_docs: int = 1000, entries: int = 16_384) -> dict[str, int]:
    """Token lengths of the most frequent words of a sample."""
    total = docs.count()
    if not total:
        return {}
    fits = docs.where(F.octet_length(F.col(f"`{text}`")) <= SAMPLE_BYTES).select(F.col(f"`{text}`").alias("t"))
    rows = fits.sample(min(1.0, sample_docs / total), seed=7).limit(2 * sample_docs).collect()
    seen: Counter[str] = Counter()
    for (t,) in rows:
        seen.update(w for w in CHUNK.findall(t) if len(w) <= 64)
    code = Encoder(vocab.value)
    return {w: len(code.encode(w)) // 4 for w, _ in seen.most_common(entries)}


def token_counts(docs: DataFrame, vocab: Shared, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), limit: int = 512,
                 sample_docs: int = 1000, entries: int = 16_384) -> DataFrame:
    """``keep`` columns, n_bytes, n_tokens and over_limit (n_tokens > limit)."""
    spark = prepare(docs.sparkSession)
    narrow, at, schema = carried(docs, keep, text)
    first = Shared(spark, frequent_lengths(docs, vocab, text=text, sample_docs=sample_docs, entries=entries))

    def run(batches):
        if first.id not in _LENGTHS:
            _LENGTHS.clear()
            _LENGTHS[first.id] = Lengths(first.value, Encoder(vocab.value))
        table = _LENGTHS[first.id]
        for batch in slices(batches, at):
            column = batch.column(at)
            tokens = np.array([table.count(t) for t in strings(column)], np.int64)
            size = pc.fill_null(pc.binary_length(column), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], size, pa.array(tokens), pa.array(tokens > limit)], [*keep, "n_bytes", "n_tokens", "over_limit"])

    return narrow.mapInArrow(run, f"{schema}, n_bytes long, n_tokens long, over_limit boolean")
