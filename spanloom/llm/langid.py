"""Language of words in code-switched text: a linear-chain conditional random field.

Each word has hashed features (its prefixes and suffixes, the letter n-grams inside, and
membership in a lexicon of frequent words of each language); between neighbouring words
stand learned transitions. Labels of words come from the language of their document. Weights
follow the gradient of the conditional likelihood, whose expectations come from
forward-backward; so do the marginals that label the words of a text. A text's language
is the one with the largest sum of marginals over its words, its score the mean.

The model is fitted on a bounded sample: the ``sample_docs`` training rows with the least hash of
their id whose text has at most ``sample_bytes`` bytes. Every text is labelled whole.

Null, empty and letterless texts are ``und`` with score 0. Rows with repeated ids are labelled
each for itself. Without labelled rows every text is ``und``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .batches import carried, fold, prepare, slices, span_hashes, strings
from .bpe import Shared

BUCKETS = 1 << 17
ORDERS = (2, 4)
BLOCK = 1 << 19
SEGMENT = 50
LETTER = np.zeros(256, bool)
LETTER[97:123] = LETTER[128:] = True


def framed(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes of all texts with 0 for all but letters; word starts, ends, first word of each text.

    Bytes outside ASCII count as letters, so a word keeps its accents; between words stands a 0
    at least, which frames the affixes.
    """
    coded = [t.lower().encode("utf-8", "replace") for t in texts]
    x = np.frombuffer(b"\0\0" + b"\0".join(coded) + b"\0" * 8, np.uint8)
    x = np.where(LETTER[x], x, 0).astype(np.uint8)
    inside = x > 0
    starts, ends = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1, np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    begin = 2 + np.concatenate([[0], np.cumsum([len(c) + 1 for c in coded])])
    return x, starts, ends, np.searchsorted(starts, begin)


def buckets(x: np.ndarray) -> list[np.ndarray]:
    """Bucket of the n-gram that starts at each byte, for each order; ``BUCKETS`` where a frame is inside."""
    out, h, ok = [], x.astype(np.uint32), np.ones(len(x), bool)
    with np.errstate(over="ignore"):
        for n in range(2, max(ORDERS) + 1):
            nxt = np.zeros(len(x), np.uint32)
            nxt[:len(x) - n + 1] = x[n - 1:]
            if n > 2:
                ok = ok & (last > 0)
            h = h * np.uint32(0x01000193) + nxt + np.uint32(n)
            last = nxt
            m = h ^ (h >> np.uint32(15))
            m = m * np.uint32(0x2C1B3C6D)
            out.append(np.where(ok, (m >> np.uint32(15)) % np.uint32(BUCKETS), np.uint32(BUCKETS)).astype(np.int64))
    return [out[n - 2] for n in ORDERS]


class Field:
    def __init__(self, languages: list[str], known: np.ndarray) -> None:
        k = len(languages)
        self.languages, self.known = languages, known  # sorted hashes of the lexicon's words
        self.weights = np.zeros((BUCKETS + 1, k))
        self.word_weights = np.zeros((len(known), k))
        self.bias, self.start = np.zeros(k), np.zeros(k)
        self.moves = np.zeros((k, k))


    def potentials(self, x: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Log potentials of words, in blocks of bounded size."""
        out = np.empty((len(starts), len(self.languages)), np.float32)
        i = 0
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK)))
            a, b = starts[i] - 1, ends[j - 1]
            rows = sum(self.weights[k] for k in buckets(x[a:b + max(ORDERS)]))
            sums = np.concatenate([np.zeros((1, rows.shape[1])), np.cumsum(rows, axis=0, dtype=float)])
            out[i:j] = sums[ends[i:j] - a] - sums[starts[i:j] - 1 - a]
            i = j
        h = span_hashes(x, starts, ends)
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
            hit = self.known[at] == h
            out[hit] += self.word_weights[at[hit]]
        return out + self.bias.astype(np.float32)


def marginals(emit: np.ndarray, first: np.ndarray, start: np.ndarray, moves: np.ndarray, pairs: bool = False):
    """Forward-backward over many sequences in step; ``first`` has where each begins (and the end).

    Returns the marginals of each position and (if asked) the expected transitions. Vectors
    are rescaled at each step.
    """
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    begin, n = first[:-1][order], n[order]
    top = emit.max(1, keepdims=True) if len(emit) else emit
    e = np.exp(emit - top)
    a, t = np.exp(start), np.exp(moves)
    alpha, beta = np.empty_like(e), np.ones_like(e)
    longest = int(n[0]) if len(n) else 0
    live = np.searchsorted(-n, -np.arange(longest), side="left")  # sequences longer than each step
    for i in range(longest):
        at = begin[:live[i]] + i
        v = e[at] * a if i == 0 else (alpha[at - 1] @ t) * e[at]
        alpha[at] = v / v.sum(1, keepdims=True)
    for i in range(longest - 2, -1, -1):
        at = begin[:live[i + 1]] + i
        v = (e[at + 1] * beta[at + 1]) @ t.T
        beta[at] = v / v.sum(1, keepdims=True)
    p = alpha * beta
    p /= np.maximum(p.sum(1, keepdims=True), 1e-300)
    if not pairs:
        return p
    inner = np.ones(len(e), bool)
    inner[first[:-1][np.diff(first) > 0]] = False
    at = np.flatnonzero(inner)
    x = alpha[at - 1][:, :, None] * t[None] * (e[at] * beta[at])[:, None, :]
    x /= x.sum((1, 2), keepdims=True)
    return p, x.sum(0)


def lexicon(h: np.ndarray, gold: np.ndarray, k: int, size: int) -> np.ndarray:
    """Hashes of frequent words that one language has at least four times as often as any other."""
    ids, at = np.unique(h, return_inverse=True)
    counts = np.column_stack([np.bincount(at[gold == j], minlength=len(ids)) for j in range(k)])
    share = counts / np.maximum(counts.sum(0), 1)
    part = np.sort(share, axis=1)
    own = (counts.max(1) > 1) & (part[:, -1] > 4 * (part[:, -2] if k > 1 else 0))
    best = np.argsort(-share.max(1) * own, kind="stable")[:size * k]
    return np.sort(ids[best[own[best]]])


def train(rows: list[tuple[str, str]], *, steps: int = 20, rate: float = 0.1, l2: float = 1e-6, lexicon_words: int = 200) -> Field | None:
    """Fit on (text, language) rows: adaptive gradient steps on the conditional likelihood."""
    names = sorted({y for _, y in rows})
    x, starts, ends, cuts = framed([t for t, _ in rows])
    if not len(starts):
        return None
    k, gold = len(names), np.repeat([names.index(y) for _, y in rows], np.diff(cuts))
    h = span_hashes(x, starts, ends)
    field = Field(names, lexicon(h, gold, k, lexicon_words))
    _, rep, seq = np.unique(h, return_index=True, return_inverse=True)
    # whole texts, cut to segments only so that sequences of one step are alike in length
    first = np.unique(np.concatenate([cuts, *[np.arange(a, b, SEGMENT) for a, b in zip(cuts[:-1], cuts[1:])]]))
    grams = buckets(x)
    size = ends[rep] - starts[rep] + 1  # places where an n-gram of the word may start
    owner = np.repeat(np.arange(len(rep)), size)
    place = np.repeat(starts[rep] - 1, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    flat, owner = np.concatenate([g[place] for g in grams]), np.tile(owner, len(grams))
    use = flat < BUCKETS
    flat, owner = flat[use], owner[use]
    known = np.searchsorted(field.known, h[rep])
    listed = np.flatnonzero((known < len(field.known)) & (field.known[np.minimum(known, len(field.known) - 1)] == h[rep])) if len(field.known) else np.zeros(0, int)
    hot = np.eye(k)[gold]
    inner = np.ones(len(seq), bool)
    inner[first[:-1]] = False
    at = np.flatnonzero(inner)
    gold_moves = np.zeros((k, k))
    np.add.at(gold_moves, (gold[at - 1], gold[at]), 1)
    heads = first[:-1][np.diff(first) > 0]
    gold_start = hot[heads].sum(0)
    learned = (field.weights, field.word_weights, field.bias, field.start, field.moves)
    past = [np.full(w.shape, 1e-8) for w in learned]

    def summed(index, values, n):
        return np.column_stack([np.bincount(index, weights=values[:, j], minlength=n) for j in range(k)])

    for _ in range(steps):
        words = summed(owner, field.weights[flat], len(rep)) + field.bias
        words[listed] += field.word_weights[known[listed]]
        p, expected = marginals(words[seq], first, field.start, field.moves, pairs=True)
        gap = hot - p
        per_word = summed(seq, gap, len(rep))
        grads = (summed(flat, per_word[owner], BUCKETS + 1) / len(seq) - l2 * field.weights, summed(known[listed], per_word[listed], len(field.known)) / len(seq) - l2 * field.word_weights,
                 gap.sum(0) / len(seq), (gold_start - p[heads].sum(0)) / len(seq), (gold_moves - expected) / len(seq))
        for w, g, q in zip(learned, grads, past):
            q += g ** 2
            w += rate * g / np.sqrt(q)
    field.weights[BUCKETS] = 0
    # labels of documents say that languages never change inside a text; leave some room for it
    np.clip(field.moves, field.moves.max() - 4.0, None, out=field.moves)
    field.weights = field.weights.astype(np.float32)
    return field


def model(docs: DataFrame, *, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", modulus: int = 4, held: int = 2,
          sample_docs: int = 400, sample_bytes: int = 16_384) -> Shared:
    """Fit on the bounded sample and broadcast."""
    spark = prepare(docs.sparkSession)
    key, body = F.col(f"`{doc_id}`"), F.col(f"`{text}`")
    usable = docs.where(F.col(f"`{lang}`").isNotNull() & (fold(doc_id) % modulus != held) & body.isNotNull() & (F.octet_length(body) <= sample_bytes))
    # two steps: the least hashes first, then the texts of those rows, so that no text is sorted
    order = F.xxhash64(key)
    least = usable.select(order.alias("h")).orderBy("h").limit(sample_docs).agg(F.max("h")).first()[0]
    rows = [] if least is None else usable.where(order <= least).select(order.alias("h"), body.alias("t"), F.col(f"`{lang}`").cast("string").alias("y")).limit(2 * sample_docs).collect()
    return Shared(spark, train(sorted((r.t, r.y) for r in rows)))


def label_words(texts: list[str], field: Field) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of all words of all texts, and where each text's begin."""
    x, starts, ends, first = framed(texts)
    return marginals(field.potentials(x, starts, ends), first, field.start.astype(np.float32), field.moves.astype(np.float32)), first


def languages(docs: DataFrame, fitted: Shared, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, lang_pred, score, and shares: the sum of marginals per language."""
    prepare(docs.sparkSession)
    narrow, at, schema = carried(docs, keep, text)

    def run(batches):
        field = fitted.value
        for batch in slices(batches, at, 8 << 20):
            n = batch.num_rows
            names, score, shares = np.full(n, "und", object), np.zeros(n), [{}] * n
            if field is not None:
                texts = strings(batch.column(at))
                p, first = label_words(texts, field)
                some = np.array([i for i in np.flatnonzero(np.diff(first)) if any(map(str.isalpha, texts[i]))], int)
                if len(some):
                    sums = np.stack([p[first[i]:first[i + 1]].sum(0, dtype=float) for i in some])
                    mean = sums / np.diff(first)[some][:, None]
                    names[some] = np.array(field.languages, object)[mean.argmax(1)]
                    score[some] = np.clip(mean.max(1), 0, 1)
                    for i, s in zip(some, sums):
                        shares[i] = dict(zip(field.languages, s.tolist()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], pa.array(names, pa.string()), pa.array(score),
                                              pa.array([list(s.items()) for s in shares], pa.map_(pa.string(), pa.float64()))], [*keep, "lang_pred", "score", "shares"])

    return narrow.mapInArrow(run, f"{schema}, lang_pred string, score double, shares map<string,double>")
