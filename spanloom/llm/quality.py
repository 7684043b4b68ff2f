"""Quality scores: kernel ridge regression with random Fourier features, then isotonic calibration.

Statistics of a text (shares of character classes, word and line shapes, repetition) are
standardised and mapped to cos(w x + b) with Gaussian w, whose inner products approximate
a Gaussian kernel. Each partition sums its own part of the normal equations; the sums are added
in a tree, and one small system (``features`` + 1 unknowns) is solved. The raw scores of all
labelled rows are counted in fixed bins and made monotone by pooling adjacent violators.

Null and empty texts have all-zero statistics and get the score of that point. Rows with
repeated ids are scored each for itself; of labels repeated for an id the least wins.
Without labelled rows every score is 0.5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .batches import carried, fold, prepare, slices, span_hashes, utf8, words
from .bpe import Shared

BINS = 1000
SPREAD = 0.5  # raw scores are counted from -SPREAD to 1 + SPREAD
NAMES = ("length", "upper", "lower", "digit", "space", "newline", "stop", "mark", "symbol", "high", "word_length", "word_length_sd",
         "distinct_words", "repeated_lines", "line_length", "longest_word", "words_per_stop", "short_words")
CLASSES = np.full(256, 7, np.uint8)
CLASSES[65:91], CLASSES[97:123], CLASSES[48:58], CLASSES[32], CLASSES[9], CLASSES[10] = 0, 1, 2, 3, 3, 4
CLASSES[[ord(c) for c in ".?"]], CLASSES[[ord(c) for c in ",;:'\"()-"]], CLASSES[128:] = 5, 6, 8


def statistics(column: pa.Array) -> np.ndarray:
    """One row of ``NAMES`` per text."""
    data, offsets = utf8(column)
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    row = np.repeat(np.arange(n), np.diff(offsets))
    share = np.bincount(row * 9 + CLASSES[data], minlength=9 * n).reshape(n, 9) / np.maximum(size, 1)[:, None]
    low, starts, ends, first = words(data, offsets)
    count = np.diff(first)
    owner = np.repeat(np.arange(n), count)
    length = (ends - starts).astype(float)
    per = np.maximum(count, 1)
    mean = np.bincount(owner, weights=length, minlength=n) / per
    sd = np.sqrt(np.maximum(np.bincount(owner, weights=length ** 2, minlength=n) / per - mean ** 2, 0))
    longest = np.zeros(n)
    np.maximum.at(longest, owner, length)
    distinct = different(owner, span_hashes(low, starts, ends), n) / per
    stops = np.bincount(row[CLASSES[data] == 5], minlength=n)
    # lines, each text ending one
    cuts = np.union1d(np.flatnonzero(data == 10) + 1, offsets)
    begin, stop = cuts[:-1], cuts[1:]
    line_row = np.searchsorted(offsets, begin, side="right") - 1
    lines = np.bincount(line_row, minlength=n)
    repeated = 1 - different(line_row, span_hashes(low, begin, stop), n) / np.maximum(lines, 1)
    out = np.column_stack([
        np.log1p(size), share[:, 0], share[:, 1], share[:, 2], share[:, 3], share[:, 4], share[:, 5], share[:, 6], share[:, 7], share[:, 8],
        mean, sd, distinct, repeated, np.log1p(size / np.maximum(lines, 1)), np.log1p(longest), np.log1p(count / (stops + 1)),
        np.bincount(owner, weights=length <= 3, minlength=n) / per,
    ])
    out[size == 0] = 0
    return out


def different(owner: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes per owner."""
    order = np.lexsort((h, owner))
    o, v = owner[order], h[order]
    new = np.ones(len(o), bool)
    new[1:] = (o[1:] != o[:-1]) | (v[1:] != v[:-1])
    return np.bincount(o[new], minlength=n)


def described(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``stats`` array<double>."""
    prepare(docs.sparkSession)
    narrow, at, schema = carried(docs, keep, text)

    def run(batches):
        for batch in slices(batches, at, 2 << 20):
            s = statistics(batch.column(at))
            lists = pa.FixedSizeListArray.from_arrays(pa.array(s.ravel()), s.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], lists], [*keep, "stats"])

    return narrow.mapInArrow(run, f"{schema}, stats array<double>")


class Kernel:
    """Standardisation, random features, ridge weights and the isotonic steps."""

    def __init__(self, mean, scale, features: int, width: float, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.w = rng.normal(size=(len(mean), features)) / width
        self.b = rng.uniform(0, 2 * np.pi, features)
        self.weights = np.zeros(features + 1)
        self.steps = np.full(BINS, 0.5)

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -6, 6)
        return np.column_stack([np.cos(x @ self.w + self.b) * np.sqrt(2 / len(self.b)), np.ones(len(x))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return self.steps[place(self.raw(stats))]


def place(raw: np.ndarray) -> np.ndarray:
    return np.clip(((raw + SPREAD) / (1 + 2 * SPREAD) * BINS).astype(int), 0, BINS - 1)


def stacked(batch: pa.RecordBatch, at: int) -> np.ndarray:
    return np.asarray(batch.column(at).flatten()).reshape(batch.num_rows, len(NAMES))


def isotonic(ones: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Pool adjacent violators over bins; empty bins take the value of the bin below (or the first)."""
    blocks: list[list[float]] = []
    for i in np.flatnonzero(total):
        blocks.append([ones[i], total[i], i])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            o, t, _ = blocks.pop()
            blocks[-1][0] += o
            blocks[-1][1] += t
    out = np.full(BINS, 0.5)
    for k, (o, t, i) in enumerate(blocks):
        out[(i if k else 0):] = o / t
    return out


def model(labelled: DataFrame, *, stats: str = "stats", label: str = "y", features: int = 200, width: float = 5.0, ridge: float = 1e-3, seed: int = 11) -> Kernel:
    """Fit on all rows of ``labelled`` (stats, label 0/1): three passes, each summed per partition."""
    spark = labelled.sparkSession
    rows = labelled.select(F.col(stats).alias("s"), F.col(label).cast("double").alias("y"))
    moments = rows.select(*[f(F.col("s")[i], i) for i in range(len(NAMES)) for f in (lambda c, i: F.sum(c).alias(f"a{i}"), lambda c, i: F.sum(c * c).alias(f"q{i}"))], F.count("*").alias("n")).first()
    n = moments["n"]
    if not n:
        return Kernel(np.zeros(len(NAMES)), np.ones(len(NAMES)), features, width, seed)
    mean = np.array([moments[f"a{i}"] for i in range(len(NAMES))]) / n
    scale = np.sqrt(np.maximum(np.array([moments[f"q{i}"] for i in range(len(NAMES))]) / n - mean ** 2, 0)) + 1e-6
    kernel = Kernel(mean, scale, features, width, seed)
    shape = Shared(spark, kernel)

    def part(batches):
        gram, right = np.zeros((features + 1, features + 1)), np.zeros(features + 1)
        for batch in batches:
            if batch.num_rows:
                z = shape.value.features(stacked(batch, 0))
                gram += z.T @ z
                right += z.T @ np.asarray(batch.column(1))
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([gram.ravel(), right]).tobytes()])], ["sums"])

    sums = rows.mapInArrow(part, "sums binary").rdd.map(lambda r: np.frombuffer(r.sums)).treeReduce(lambda a, b: a + b, depth=3)
    gram, right = sums[:-features - 1].reshape(features + 1, -1), sums[-features - 1:]
    kernel.weights = np.linalg.solve(gram + ridge * n * np.diag([*np.full(features, 1 / features), 0.0]) + 1e-9 * np.eye(features + 1), right)
    fitted = Shared(spark, kernel)

    def binned(batches):
        hist = np.zeros((2, BINS), np.int64)
        for batch in batches:
            if batch.num_rows:
                b, y = place(fitted.value.raw(stacked(batch, 0))), np.asarray(batch.column(1)).astype(int)
                np.add.at(hist, (y, b), 1)
        y, b = np.nonzero(hist)
        yield pa.RecordBatch.from_arrays([pa.array(y.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(hist[y, b])], ["y", "b", "n"])

    hist = np.zeros((2, BINS))
    for r in rows.mapInArrow(binned, "y int, b int, n long").groupBy("y", "b").agg(F.sum("n").alias("n")).collect():
        hist[r.y, r.b] = r.n
    kernel.steps = isotonic(hist[1], hist.sum(0))
    return kernel


def labelled_rows(stats: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", label: str = "quality", modulus: int = 5, held: int = 0) -> DataFrame:
    """Training rows: stats joined to labels by id, outside the held-out part."""
    y = (labels.where(F.col(f"`{label}`").isin(0, 1) & F.col(f"`{doc_id}`").isNotNull() & (fold(doc_id) % modulus != held))
         .groupBy(F.col(f"`{doc_id}`").alias("k")).agg(F.min(F.col(f"`{label}`").cast("int")).alias("y")))
    return stats.join(y, stats[f"`{doc_id}`"] == y.k).select("stats", "y")


def scores(stats: DataFrame, kernel: Kernel, *, keep: tuple[str, ...] = ("doc_id",), threshold: float = 0.3) -> DataFrame:
    """``keep`` columns, score and predicted."""
    fitted = Shared(stats.sparkSession, kernel)
    narrow = stats.select(*[F.col(f"`{c}`") for c in keep], "stats")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                s = fitted.value.score(stacked(batch, len(keep)))
                yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], pa.array(s), pa.array((s >= threshold).astype(np.int32))], [*keep, "score", "predicted"])

    schema = ", ".join(f"`{c}` {narrow.schema[c].dataType.simpleString()}" for c in keep)
    return narrow.mapInArrow(run, f"{schema}, score double, predicted int")
