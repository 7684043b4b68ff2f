"""Toxicity by class-conditional Kneser-Ney models over letters.

Texts are folded to 32 symbols (letters without accents, space, digit, other), so there
are exactly 2**20 4-grams, and every table has that many entries, however large the corpus.
A 4-gram counts once per text, so that one text that repeats itself weighs no more than others.
Counts of each class come from labelled rows; the lower order, to which both classes back off,
is the continuation distribution of 4-gram types over all texts:

    P_c(x | abc) = max(n_c(abcx) - D, 0) / n_c(abc) + D t_c(abc) / n_c(abc) * P(x | bc)

P is shared, so it cancels where neither class knows an expression, and rare expressions move
little. A text's log-likelihood ratio is divided by its length in different 4-grams. A logistic
curve turns it into a score; it is fitted to ratios of labelled rows under a model that hasn't
seen them (``FOLDS`` parts, each rated by the model of the others).

At most ``max_labels`` labelled rows (those with the least hashes of the id) are used, which
bounds what is broadcast. Counts of the shared order cover all rows.

Null and empty texts have ratio 0. Rows with repeated ids are scored each for itself; of
labels repeated for an id the least wins. Without labels of both classes the score is 0.5 where
nothing is known, or the share of toxic labels.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .batches import carried, fold, kept, prepare, slices, strings
from .bpe import Shared

ORDER, BITS = 4, 5
SIZE = 1 << (ORDER * BITS)
DISCOUNT = 0.75
BINS = 4000
FOLDS = 4
RANGE = 2.0
PIECE = 1 << 18


def folding() -> np.ndarray:
    """Symbol of each of the first code points: 0 space, 1-26 letters, 28 other letters, 29 digits, 27 rest."""
    table = np.full(0x250, 27, np.int32)
    for cp in range(len(table)):
        base = unicodedata.normalize("NFKD", chr(cp))[0].lower()
        if "a" <= base <= "z":
            table[cp] = ord(base) - 96
        elif chr(cp).isalpha():
            table[cp] = 28
        elif chr(cp).isdigit():
            table[cp] = 29
        elif chr(cp).isspace():
            table[cp] = 0
    return table


FOLD = folding()


def scratch() -> np.ndarray:
    return kept("toxicity", None, lambda: np.zeros(SIZE, np.int32))


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Different 4-grams of each text (framed by spaces) and the row of each; some texts at a time, as the arrays in between take many times the text."""
    texts = strings(column)
    ends = np.cumsum([len(t) for t in texts])
    found, i = [], 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PIECE, side="right")))
        g, row = _grams(texts[i:j])
        found.append((g, row + i))
        i = j
    if len(found) == 1:
        return found[0]
    return tuple(np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64 if k else np.int32) for k in range(2))


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    joined = " " + " ".join(texts) + " "
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    x = np.where(points < len(FOLD), FOLD[np.minimum(points, len(FOLD) - 1)], 28)
    n = np.array([len(t) + 1 for t in texts])
    row = np.repeat(np.arange(len(texts)), n)
    g = np.zeros(max(0, len(x) - ORDER + 1), np.int32)
    for k in range(ORDER):
        g = (g << BITS) + x[k:k + len(g)]
    # a frame is a text with the spaces around it; 4-grams over two frames are dropped
    same = row[:len(g)] == row[2:2 + len(g)]
    g, row = g[same], row[2:2 + len(g)][same]
    # the last place of each 4-gram in its text stays
    last, place, stays = scratch(), np.arange(len(g), dtype=np.int32), np.zeros(len(g), bool)
    for a, b in zip(*(np.searchsorted(row, np.arange(len(texts)), side=s).tolist() for s in ("left", "right"))):
        last[g[a:b]] = place[a:b]
        stays[a:b] = last[g[a:b]] == place[a:b]
    return g[stays], row[stays]


def ratios(toxic: np.ndarray, plain: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """log P_toxic - log P_plain of every 4-gram; 0 where neither class has its context."""
    gram = np.arange(SIZE)
    suffix, context = gram & (SIZE // 32 - 1), gram >> BITS
    types = seen > 0
    cont = np.bincount(suffix[types], minlength=SIZE // 32).astype(float)  # types that end in this 3-gram
    low = np.arange(SIZE // 32) >> BITS
    total, kinds = np.bincount(low, weights=cont), np.bincount(low, weights=cont > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        shared = np.where(total[low] > 0, np.maximum(cont - DISCOUNT, 0) / total[low] + DISCOUNT * kinds[low] / total[low] / 32, 1 / 32)
        out = np.zeros(SIZE)
        for counts, sign in ((toxic, 1.0), (plain, -1.0)):
            n = np.bincount(context, weights=counts)
            t = np.bincount(context, weights=counts > 0)
            back = np.where(n > 0, DISCOUNT * t / np.maximum(n, 1), 1.0)
            p = np.maximum(counts - DISCOUNT, 0) / np.maximum(n, 1)[context] + back[context] * shared[suffix]
            out += sign * np.log(np.maximum(p, 1e-12))
    return out.astype(np.float32)


def label_codes(docs: DataFrame, labels: DataFrame, doc_id: str, label: str, modulus: int, held: int, max_labels: int) -> dict:
    """doc_id -> (class, fold), for at most ``max_labels`` labelled training rows."""
    key, f = F.col(f"`{doc_id}`"), fold(doc_id)
    rows = (labels.where(F.col(f"`{label}`").isin(0, 1) & key.isNotNull() & (f % modulus != held))
            .groupBy(key.alias("k")).agg(F.min(F.col(f"`{label}`").cast("int")).alias("y"))
            .orderBy(F.xxhash64("k"), "k").limit(max_labels))
    return {r.k: (r.y, i % FOLDS) for i, r in enumerate(rows.collect())}


def model(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", max_labels: int = 262_144) -> Shared:
    """The broadcast table of ratios with the calibration (slope, intercept)."""
    spark = prepare(docs.sparkSession)
    codes = Shared(spark, label_codes(docs, labels, doc_id, label, 4, 2, max_labels))
    narrow = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("__text"))

    names = [f"c{k}" for k in range(2 * FOLDS)] + ["n"]

    def counted(batches):
        known, total = codes.value, np.zeros((2 * FOLDS + 1, SIZE), np.int32)
        for batch in slices(batches, limit=2 << 20):
            g, row = grams(batch.column(1))
            total[-1] += np.bincount(g, minlength=SIZE).astype(np.int32)
            group = np.array([FOLDS * c[0] + c[1] if (c := known.get(i)) else -1 for i in batch.column(0).to_pylist()])
            own = group[row]
            for k in np.unique(group[group >= 0]):
                total[k] += np.bincount(g[own == k], minlength=SIZE).astype(np.int32)
        at = np.flatnonzero(total[-1])
        for part in np.array_split(at, -(-len(at) // 50_000)) if len(at) else []:
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), *[pa.array(t[part].astype(np.int64)) for t in total]], ["g", *names])

    per_task = narrow.mapInArrow(counted, "g int, " + ", ".join(f"{c} long" for c in names))
    found = per_task.groupBy("g").agg(*[F.sum(c).alias(c) for c in names]).toArrow()  # 2**20 rows at most
    dense = np.zeros((2 * FOLDS + 1, SIZE))
    index = found.column("g").to_numpy()
    for k, c in enumerate(names):
        dense[k, index] = found.column(c).to_numpy()
    plain, toxic, seen = dense[:FOLDS], dense[FOLDS:-1], dense[-1]
    apart = Shared(spark, np.stack([ratios(toxic.sum(0) - toxic[k], plain.sum(0) - plain[k], seen) for k in range(FOLDS)]))

    def rated(batches):
        known, tables = codes.value, apart.value
        bins = np.zeros((2, BINS), np.int64)
        for batch in slices(batches, limit=2 << 20):
            group = [known.get(i) for i in batch.column(0).to_pylist()]
            keep = [i for i, c in enumerate(group) if c]
            if keep:
                part = batch.take(pa.array(keep))
                g, row = grams(part.column(1))
                fold_of = np.array([group[i][1] for i in keep])
                r = mean_ratio(tables[fold_of[row], g], row, len(keep))
                for i, b in zip(keep, place(r)):
                    bins[group[i][0], b] += 1
        y, b = np.nonzero(bins)
        yield pa.RecordBatch.from_arrays([pa.array(y.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(bins[y, b])], ["y", "b", "n"])

    hist = np.zeros((2, BINS))
    for r in narrow.mapInArrow(rated, "y int, b int, n long").groupBy("y", "b").agg(F.sum("n").alias("n")).collect():
        hist[r.y, r.b] = r.n
    return Shared(spark, (ratios(toxic.sum(0), plain.sum(0), seen), *calibration(hist)))


def mean_ratio(values: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(row, weights=values, minlength=n) / np.maximum(np.bincount(row, minlength=n), 1)


def place(r: np.ndarray) -> np.ndarray:
    return np.clip(((r + RANGE) / (2 * RANGE) * BINS).astype(int), 0, BINS - 1)


def calibration(hist: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the logistic curve, by Newton steps on the histogram."""
    if hist.sum() == 0:
        return 0.0, 0.0
    if not hist.sum(1).all():
        return 0.0, float(np.log((hist[1].sum() + 0.5) / (hist[0].sum() + 0.5)))
    x = (np.arange(BINS) + 0.5) / BINS * 2 * RANGE - RANGE
    scale = 0.05
    z = np.stack([x / scale, np.ones(BINS)])
    n = hist.sum(0)
    w = np.zeros(2)

    def loss(w):
        s = w @ z
        return (n * np.logaddexp(0, s) - hist[1] * s).sum() + 0.5 * w[0] ** 2

    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(w @ z, -30, 30)))
        grad = z @ (n * p - hist[1]) + np.array([w[0], 0])
        hess = (z * (n * p * (1 - p))) @ z.T + np.diag([1.0, 1e-9])
        step, size, now = np.linalg.solve(hess, grad), 1.0, loss(w)
        while size > 1e-4 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def scores(docs: DataFrame, fitted: Shared, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), threshold: float = 0.3) -> DataFrame:
    """``keep`` columns, score, predicted and ratio (the mean log-likelihood ratio)."""
    prepare(docs.sparkSession)
    narrow, at, schema = carried(docs, keep, text)

    def run(batches):
        table, slope, intercept = fitted.value
        for batch in slices(batches, at, 1 << 20):
            g, row = grams(batch.column(at))
            r = mean_ratio(table[g], row, batch.num_rows)
            s = 1 / (1 + np.exp(-np.clip(slope * r + intercept, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], pa.array(s), pa.array((s >= threshold).astype(np.int32)), pa.array(r)], [*keep, "score", "predicted", "ratio"])

    return narrow.mapInArrow(run, f"{schema}, score double, predicted int, ratio double")
