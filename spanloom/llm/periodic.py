"""Periodic runs of words, by internal pattern matching.

A run is a stretch of consecutive words with smallest period q, at least ``max(6, 4 * q)`` words
long, that no neighbouring word extends with period q. Runs are found so:

1. Words become numbers, texts of one batch stand one after another, each with an end mark of its
   own. Prefix doubling sorts the suffixes; after its step for m words, every dyadic block of m
   words (m = 2, 4, 8, …; aligned in its text) knows its interval of the suffix array.
2. A run of period q holds a whole aligned block of m words, 3/4 q <= m < 3/2 q, together with its
   copy q words on. So each block asks for its occurrences (2m-1)/3 to (4m-1)/3 words on:
   range successor queries in its interval, answered by a wavelet matrix over the suffix array.
3. Up to two occurrences are candidate periods. Three or more form a progression whose
   difference p is the block's own period. If the stretch of period p around the block reaches the
   last occurrence, no run of this window has a smallest period above p (periodicity lemma). Else a
   run maps one end of that stretch onto the same end of the stretch around the occurrences; the
   distances of their two left and two right ends are the only candidates.
4. Candidates are compared word by word to both sides. Periods rise, so one that lies in a known
   run of a period that divides it isn't the smallest.

Everything about one text happens in one task, batches of texts share arrays; memory is some
ninety bytes a word of one batch (``BATCH`` bytes of text, or one longer text).

Null, empty and blank texts have no words and no run. Repeated rows are answered each. A null id
leaves a text unaltered by ``altered``. Columns other than ``keep`` and the text do not travel.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .batches import carried, prepare, slices
from .wavelet import WaveletMatrix

SHORTEST = 6
TIMES = 4
#: text bytes whose words share one suffix array
BATCH = 1 << 20


@dataclass(frozen=True)
class Run:
    start: int
    length: int
    period: int


def window(m: int) -> tuple[int, int]:
    """Distances at which a block of m words looks for itself; windows of m = 2, 4, 8, … adjoin."""
    return -(-(2 * m - 1) // 3), -(-(4 * m - 1) // 3) - 1


class Blocks:
    """Blocks of every dyadic length with their suffix array intervals, and the suffix array.

    ``text`` holds word numbers with a different end mark after each text. Doubling stops at the
    longest block a run of the longest text can need; suffixes that agree so far stay unsorted.
    Only suffixes whose prefix occurs again are sorted further.
    """

    def __init__(self, text: np.ndarray, first: np.ndarray, longest: int) -> None:
        n = len(text)
        self.found: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        # distance of each position to the mark that ends its text
        counts = np.diff(first)
        ends = np.repeat(first[1:] - 1, counts)
        offset = np.arange(n) - np.repeat(first[:-1], counts)
        order = np.argsort(text, kind="stable")
        sizes = np.zeros(n + 1, np.int64)
        rank = np.empty(n, np.int64)
        self._regroup(np.arange(n), order, text[order], rank, sizes)
        active = np.flatnonzero(sizes[rank[order]] > 1)
        h = 1
        while 2 * h <= longest and len(active):
            at = order[active]
            after = np.minimum(at + h, n - 1)
            key = rank[at] * (n + 1) + rank[after]
            turn = np.argsort(key, kind="stable")
            order[active] = at[turn]
            self._regroup(active, at[turn], key[turn], rank, sizes)
            h *= 2
            at = order[active]
            group = rank[at]
            shared = sizes[group] > 1
            active, at, group = active[shared], at[shared], group[shared]
            block = (offset[at] % h == 0) & (at + h <= ends[at])
            if block.any():
                self.found.append((h, at[block], group[block], group[block] + sizes[group[block]]))
        self.order, self.ends = order, ends

    @staticmethod
    def _regroup(slots: np.ndarray, at: np.ndarray, keys: np.ndarray, rank: np.ndarray, sizes: np.ndarray) -> None:
        """Equal keys in neighbouring slots are one group, named by its first slot."""
        if not len(slots):
            return
        new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        count = np.diff(np.append(new, len(slots)))
        rank[at] = np.repeat(slots[new], count)
        sizes[slots[new]] = count


def _reach(text: np.ndarray, x: int, limit: int, p: int) -> int:
    """First position from x on, at most ``limit``, that differs from the word p before it."""
    step = 16
    while x < limit:
        stop = min(limit, x + step)
        differ = text[x:stop] != text[x - p:stop - p]
        at = int(differ.argmax())
        if differ[at]:
            return x + at
        x, step = stop, step * 2
    return limit


def _back(text: np.ndarray, x: int, limit: int, p: int) -> int:
    """Least start of a stretch of period p that holds position x, not before ``limit``."""
    step = 16
    while x > limit:
        stop = max(limit, x - step)
        differ = text[stop:x] != text[stop + p:x + p]
        if differ.any():
            return x - int(differ[::-1].argmax())
        x, step = stop, step * 2
    return limit


class _Known:
    """Runs of one text found so far, by period, each by rising start and end."""

    def __init__(self) -> None:
        self.spans: dict[int, tuple[list[int], list[int]]] = {}

    def add(self, start: int, end: int, period: int) -> None:
        starts, ends = self.spans.setdefault(period, ([], []))
        starts.append(start)
        ends.append(end)

    def divides(self, start: int, end: int, period: int) -> bool:
        """Whether a run of a smaller period that divides this one holds the stretch."""
        for p, (starts, ends) in self.spans.items():
            if p < period and period % p == 0:
                at = bisect_right(starts, start) - 1
                if at >= 0 and ends[at] >= end:
                    return True
        return False


def _candidates(m: int, at, l, r, begins, ends, tree: WaveletMatrix, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Periods and positions of the copies that blocks of m words meet in their windows, sorted, each once."""
    lo, hi = window(m)
    last = np.minimum(at + hi, ends[at] - m)  # the copy ends within the text
    ok = last >= at + lo
    at, l, r, last = at[ok], l[ok], r[ok], last[ok]
    before = tree.below(l, r, at + lo)
    count = tree.below(l, r, last + 1) - before
    ok = count > 0
    at, l, r, before, count = at[ok], l[ok], r[ok], before[ok], count[ok]
    near = tree.kth(l, r, before)
    far = tree.kth(l, r, before + count - 1)
    few = count <= 2
    more: list[tuple[int, int]] = []
    for i, a, b, c in zip(at[~few].tolist(), near[~few].tolist(), far[~few].tolist(), count[~few].tolist()):
        p = (b - a) // (c - 1)
        begin, end = int(begins[i]), int(ends[i])
        right = _reach(text, i + p, min(end, b + m), p)
        if right >= b + m:
            continue
        # an end further away than the window is no candidate, so no search goes further
        left = _back(text, a, begin, p)
        more.append((left - _back(text, i, max(begin, left - hi - 1), p), i))
        more.append((_reach(text, b + p, min(end, right + hi + 1), p) - right, i))
    extra = np.array(more, np.int64).reshape(-1, 2)
    d = np.concatenate([(near - at)[few], (far - at)[few], extra[:, 0]])
    i = np.concatenate([at[few], at[few], extra[:, 1]])
    ok = (d >= lo) & (d <= hi) & (i + d < ends[i])
    pairs = np.unique(np.stack([d[ok], i[ok]]), axis=1)
    return pairs[0], pairs[1]


def runs(ids: np.ndarray, offsets: np.ndarray) -> list[list[Run]]:
    """The runs of each text, by start, then period; text k is ``ids[offsets[k]:offsets[k + 1]]``."""
    counts = np.diff(offsets)
    out: list[list[Run]] = [[] for _ in counts]
    use = np.flatnonzero(counts >= SHORTEST)
    if not len(use):
        return out
    longest = 2
    while window(2 * longest)[0] * TIMES <= counts.max():
        longest *= 2
    marks = int(ids.max()) + 1
    text = np.concatenate([part for k in use for part in (ids[offsets[k]:offsets[k + 1]], [marks + k])]).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(counts[use] + 1)])
    blocks = Blocks(text, first, longest)
    if not blocks.found:
        return out
    tree = WaveletMatrix(blocks.order)
    begins = np.repeat(first[:-1], counts[use] + 1)
    known: dict[int, _Known] = {}
    for m, at, l, r in blocks.found:
        periods, positions = _candidates(m, at, l, r, begins, blocks.ends, tree, text)
        owners = np.searchsorted(first, positions, side="right") - 1
        seen: tuple[int, int] | None = None
        covered = 0
        for d, i, k in zip(periods.tolist(), positions.tolist(), owners.tolist()):
            if seen == (k, d) and i < covered:  # in the stretch of period d just measured
                continue
            begin, end = int(first[k]), int(first[k + 1]) - 1
            right = _reach(text, i + d, end, d)
            left = _back(text, i, begin, d)
            seen, covered = (k, d), right - d
            if right - left < max(SHORTEST, TIMES * d):
                continue
            mine = known.setdefault(k, _Known())
            if not mine.divides(left, right, d):
                mine.add(left, right, d)
                out[use[k]].append(Run(left - begin, right - left, d))
    for found in out:
        found.sort(key=lambda x: (x.start, x.period))
    return out


def strongest(found: list[Run]) -> Run | None:
    """Greatest length / period, compared exactly; then least start, then least period."""
    best = None
    for x in found:  # by start, then period
        if best is None or x.length * best.period > best.length * x.period:
            best = x
    return best


def altered(n: int, doc_id: int | None) -> np.ndarray | None:
    """Word numbers of a text made periodic from some word on, for ids that the contract picks; else None."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    order = np.arange(n)
    order[a:] = a + (order[a:] - a) % p
    return order


FOUND = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def _words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, and the first word of each text; only ASCII white space parts them."""
    lists = pc.ascii_split_whitespace(pc.fill_null(column, ""))
    flat, bounds = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    real = np.asarray(pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False), bool)
    before = np.concatenate([[0], np.cumsum(real)])
    return flat.filter(pa.array(real)), before[bounds - bounds[0]]


def _coded(flat: pa.Array) -> tuple[np.ndarray, pa.Array]:
    coded = flat.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def collapsed_words(n: int, found: list[Run]) -> np.ndarray:
    """Which words stay: of each run the first period, unless another run drops them."""
    drop = np.zeros(n + 1, np.int64)
    for x in found:
        drop[x.start + x.period] += 1
        drop[x.start + x.length] -= 1
    return np.cumsum(drop)[:n] == 0


def periodic_runs(docs: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), alter: str | None = None) -> DataFrame:
    """``keep`` columns, n_words, runs (by start, then period) and the text with repetitions collapsed.

    ``alter`` names the id column by which ``altered`` first changes the words.
    """
    prepare(docs.sparkSession)
    narrow, at, schema = carried(docs, keep, text)
    by = keep.index(alter) if alter else None
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches):
        for batch in slices(batches, at, BATCH):
            flat, offsets = _words(batch.column(at))
            ids, names = _coded(flat)
            if by is not None:
                for k, doc in enumerate(batch.column(by).to_pylist()):
                    order = altered(int(offsets[k + 1] - offsets[k]), doc)
                    if order is not None:
                        ids[offsets[k]:offsets[k + 1]] = ids[offsets[k]:offsets[k + 1]][order]
            found = runs(ids, offsets)
            stays = np.ones(len(ids), bool)
            for k, x in enumerate(found):
                if x:
                    stays[offsets[k]:offsets[k + 1]] = collapsed_words(int(offsets[k + 1] - offsets[k]), x)
            kept = np.concatenate([[0], np.cumsum(stays)])[offsets]
            chosen = names.take(pa.array(ids[stays]))
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(kept, pa.int32()), chosen), " ")
            rows = [[{"start": x.start, "length": x.length, "period": x.period} for x in f] for f in found]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(keep)], pa.array(np.diff(offsets)), pa.array(rows, kind), joined], [*keep, "n_words", "runs", "collapsed"])

    return narrow.mapInArrow(run, f"{schema}, {FOUND}")


def report(found: DataFrame) -> DataFrame:
    """Per document the number of runs, the strongest run, and digests of all runs and of the collapsed text."""
    stronger = "a.length * b.period > b.length * a.period"
    best = F.expr(f"aggregate(runs, cast(null as struct<start:long,length:long,period:long>), (b, a) -> if(b is null or {stronger}, a, b))")
    lines = F.expr("concat_ws('', transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')))")
    return found.withColumn("__best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        F.col("__best.start").alias("start"), F.col("__best.length").alias("length"), F.col("__best.period").alias("period"),
        F.expr("1000 * __best.length div __best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def brute_force(words: list[str]) -> list[Run]:
    """Every run by its definition; for tests."""
    n, seen = len(words), []
    for q in range(1, n // TIMES + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(SHORTEST, TIMES * q):
                part = words[i:j + q]
                if not any(all(part[x] == part[x + p] for x in range(len(part) - p)) for p in range(1, q)):
                    seen.append(Run(i, j + q - i, q))
            i = j + 1 if j > i else i + 1
    return sorted(seen, key=lambda x: (x.start, x.period))


def digest(found: list[Run]) -> str:
    return hashlib.sha256("".join(f"{x.start},{x.length},{x.period}\n" for x in found).encode()).hexdigest()
