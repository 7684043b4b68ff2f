"""Near duplicates: consistent weighted sampling over TF-IDF shingles, banded, then verified.

Weights. A document's shingles are its runs of five words; a shingle's weight is its count
times 1 + idf/8, with idf = log(N / df) / log(N) between 0 and 1, so frequent passages count
less than rare ones, by a ninth at most: words changed in a much-copied text are rare, and must not
outweigh what the copies share. Document frequencies cover all documents, in a table of
2**18 hashed counts from which the mean load of a cell is taken off. Counts are rounded to
steps of 1/4 in the logarithm, idf to thirds; the rounded weights are meant everywhere below.

Samples. Improved consistent weighted sampling: a shingle's r, c ~ Gamma(2, 1) and b ~ U(0, 1)
depend on the shingle and the sample's number only; t = floor(ln w / r + b) and a = c / exp(r (t - b) + r);
the sample is (shingle, t) of the least a. Two documents agree in a sample with the probability of
their weighted Jaccard similarity. r, b, c are drawn from a table of 2**16 triples by a hash of the
shingle and the sample's number; as weights have few steps, a and t are tables too.

Candidates. 24 bands of 5 samples: a pair of similarity 0.8 meets in some band with probability
0.9999. Documents of equal words are first replaced by one of them. In a bucket of at most ``FEW``
documents all pairs are candidates. In a larger one, each document is paired with the least of the
bucket, with the least of those that agree in a sixth, and a seventh, sample too, and with the
``NEIGHBOURS`` before it when the bucket is sorted by the samples that follow the band, which are those
that share the longest run of samples with it; groups of copies are so joined by trees and
chains. These pairs come first only to save work: once they are verified, every pair of a large
bucket that the links found so far leave in two components is compared too (``crowded``), where the bucket's
parts meet, so all pairs of all buckets are judged but those whose link would change nothing. One byte of each of the
120 samples is kept to drop pairs whose estimated similarity is 5 standard errors below the threshold.

Verification. The weighted Jaccard similarity is computed from both whole texts: first for the best
partner of each document, then for all remaining candidates whose ends aren't yet in one
component, then in ``crowded``; a link inside a component would not change it. A pair whose shingles without weights reach
the threshold is a link as well.

Null, empty and wordless texts are each a class of their own. A text of one to four words has one
shingle. Rows that repeat an id with different texts are compared each for itself, under a key of their
own (``keyed``); an id has one class, so ids that share a class by any of their rows are together.
Rows without an id are left out of the report.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .batches import MULTIPLIER, kept, mixed, prepare, shingles, slices, span_hashes, utf8, words
from .bpe import Shared
from .components import components
from .shared import release, settled

WORDS = 5
BANDS, ROWS = 24, 5
SAMPLES = BANDS * ROWS
CELLS = 1 << 18
SLOTS = 1 << 16
FEW = 8
NEIGHBOURS = 2
CHUNK = 1024
MARKS = 1 << 24
PART = 8 << 20
COUNTS, RARITIES = 32, 4
LEVELS = COUNTS * RARITIES
#: Weight of each level: e**(c/4) for a count, times 1 to 1 + 1/8 for rarity.
WEIGHTS = (np.exp(np.arange(COUNTS) / 4)[:, None] * (1 + np.arange(RARITIES) / (RARITIES - 1) / 8)).ravel()
SLICE = 1 << 19


class Frequencies:
    """Hashed document frequencies, as the rarity level of each cell."""

    def __init__(self, counts: np.ndarray, documents: int) -> None:
        load = counts.sum() / CELLS
        df = np.maximum(1.0, counts - load)
        n = max(documents, 2)
        self.rarity = np.rint(np.clip(np.log(n / df) / np.log(n), 0, 1) * (RARITIES - 1)).astype(np.int8)


def cell(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(46)).astype(np.int64)


def weighted(column: pa.Array, frequencies: Frequencies | None):
    """Distinct shingles of each text: hashes, level of each, first of each text; and word-list digests."""
    data, offsets = utf8(column)
    low, starts, ends, first = words(data, offsets)
    h = span_hashes(low, starts, ends)
    s, at = shingles(h, first, WORDS)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((s, row))
    s, row = s[order], row[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (row[1:] != row[:-1])
    place = np.flatnonzero(new)
    count = np.diff(np.append(place, len(s)))
    s, row = s[place], row[place]
    begin = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(at) - 1))])
    level = None
    if frequencies is not None:
        level = np.minimum(np.rint(np.log(count) * 4).astype(np.int64), COUNTS - 1) * RARITIES + frequencies.rarity[cell(s)]
    return s, level, begin, (h, first)


def digest(h: np.ndarray, first: np.ndarray) -> list[bytes]:
    """128 bits of each text's word list."""
    n = np.diff(first)
    place = (np.arange(len(h)) - np.repeat(first[:-1], n)).astype(np.uint64)
    out = np.zeros((len(n), 2), np.uint64)
    some = np.flatnonzero(n)
    if len(some):
        with np.errstate(over="ignore"):
            for k in range(2):
                mix = mixed((h + np.uint64(k)) * (place * np.uint64(2) + np.uint64(1)) * MULTIPLIER + place + np.uint64(k))
                out[some, k] = np.add.reduceat(mix, first[:-1][some])
    out[:, 0] ^= n.astype(np.uint64)
    return [x.tobytes() for x in out]


class Sampler:
    """Tables of a and t for each level and slot, and a multiplier for each sample.

    A level's table is filled when a text first has that level: texts have few of them, and all take 64 MB.
    """

    def __init__(self, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.r, self.c, self.b = rng.gamma(2, 1, SLOTS), rng.gamma(2, 1, SLOTS), rng.random(SLOTS)
        self.log, self.filled = np.log(WEIGHTS), np.zeros(LEVELS, bool)
        self.key = np.zeros(LEVELS * SLOTS, np.uint64)  # pages that are never written take no memory
        self.multipliers = rng.integers(0, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def fill(self, level: np.ndarray) -> None:
        for v in np.flatnonzero((np.bincount(level, minlength=LEVELS) > 0) & ~self.filled):
            t = np.floor(self.log[v] / self.r + self.b)
            a = (self.c / np.exp(self.r * (t - self.b) + self.r)).astype(np.float32)
            # the order of positive floats is that of their bits; t tells apart two weights of one shingle
            self.key[v * SLOTS:(v + 1) * SLOTS] = (a.view(np.uint32).astype(np.uint64) << np.uint64(32)) | ((t.astype(np.int64).astype(np.uint64) & np.uint64(0xFF)) << np.uint64(24))
            self.filled[v] = True

    def samples(self, s: np.ndarray, level: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """(texts, SAMPLES) of uint64; a text without shingles has zeros."""
        self.fill(level)
        out = np.zeros((len(begin) - 1, SAMPLES), np.uint64)
        some = np.flatnonzero(np.diff(begin))
        i = 0
        while i < len(some):
            # blocks that stay in the cache; one long text may be a block of its own
            j = max(i + 1, int(np.searchsorted(begin[some], begin[some[i]] + 32_768)))
            part = some[i:j]
            a, b = begin[part[0]], begin[part[-1] + 1]
            h, base, low = s[a:b], level[a:b] * SLOTS, s[a:b] & np.uint64(0xFFFFFF)
            heads = begin[part] - a
            with np.errstate(over="ignore"):
                for k in range(SAMPLES):
                    slot = ((h * self.multipliers[k]) >> np.uint64(48)).astype(np.int64)
                    slot += base
                    out[part, k] = np.minimum.reduceat(self.key[slot] | low, heads)
            i = j
        return out & np.uint64(0xFFFFFFFF)


def worker_sampler() -> Sampler:
    return kept("neardup", None, Sampler)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Jaccard of two (sorted hashes, weights): the weighted one, or the plain one where that is higher."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    either = a[1].sum() + b[1].sum() - both
    if not either:
        return 1.0
    return max(float(both / either), len(i) / (len(a[0]) + len(b[0]) - len(i)))


def document_frequencies(narrow: DataFrame) -> Shared:
    """One pass over all texts; each task adds up its cells first."""
    def counted(batches):
        total, n = np.zeros(CELLS, np.int64), 0
        for batch in slices(batches, limit=SLICE):
            s, _, _, _ = weighted(batch.column(1), None)
            total += np.bincount(cell(s), minlength=CELLS)
            n += batch.num_rows
        at = np.flatnonzero(total)
        for part in np.array_split(at, -(-len(at) // 50_000)) if len(at) else []:
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part])], ["c", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([n])], ["c", "n"])

    found = narrow.mapInArrow(counted, "c int, n long").groupBy("c").agg(F.sum("n").alias("n")).toArrow()
    index, values = found.column("c").to_numpy(), found.column("n").to_numpy()
    counts = np.zeros(CELLS)
    counts[index[index >= 0]] = values[index >= 0]
    return Shared(narrow.sparkSession, Frequencies(counts, int(values[index < 0].sum())))


def signatures(narrow: DataFrame, frequencies: Shared) -> DataFrame:
    """id, digest, n (words), band keys array<long>, sample bytes."""
    def run(batches):
        sampler = worker_sampler()
        for batch in slices(batches, limit=SLICE):
            s, level, begin, (h, first) = weighted(batch.column(1), frequencies.value)
            x = sampler.samples(s, level, begin)
            with np.errstate(over="ignore"):
                keys = np.zeros((len(x), BANDS), np.uint64)
                for k in range(ROWS):
                    keys = mixed(keys * MULTIPLIER + x[:, k::ROWS] + np.uint64(k + 1))
                # the three low bits are as good as any others; the band's number takes the rest apart
                keys = mixed(keys + np.arange(BANDS, dtype=np.uint64) * MULTIPLIER)
                small = mixed(x * MULTIPLIER).astype(np.uint8)
            bands = pa.FixedSizeListArray.from_arrays(pa.array(keys.view(np.int64).ravel()), BANDS).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digest(h, first), pa.binary()), pa.array(np.diff(first)), bands, pa.array([r.tobytes() for r in small], pa.binary())],
                                             ["id", "digest", "n", "bands", "bytes"])

    kind = narrow.schema["id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"id {kind}, digest binary, n long, bands array<long>, bytes binary")


def buckets(rows: DataFrame) -> DataFrame:
    """(id, band, key, n, low) of every bucket of two documents or more: its size and least id.

    Most buckets hold one document; what follows a bucket's key is shuffled for the others only.
    """
    keyed = rows.select("id", F.posexplode("bands").alias("band", "key"))
    many = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("low")).where("n > 1")
    return settled(keyed.join(many, "key").select("id", "band", "key", "n", "low"))


def only(narrow: DataFrame, ids: DataFrame) -> DataFrame:
    """One row (id, text) for each id that is among ``ids``, also where rows of ``narrow`` repeat; few others are shuffled for that.

    A table of ``MARKS`` bits, one set for each of ``ids`` by its hash, drops most other texts where they are read;
    the join drops the rest.
    """
    mark = F.xxhash64("id").bitwiseAND(F.lit(MARKS - 1))
    set_bits = (ids.select(mark.alias("m")).groupBy(F.shiftright("m", 6).alias("w"))
                .agg(F.bit_or(F.expr("shiftleft(1L, CAST(m & 63 AS INT))")).alias("bits")).toArrow())
    table = np.zeros(MARKS >> 6, np.uint64)
    table[set_bits.column("w").to_numpy()] = set_bits.column("bits").to_numpy().view(np.uint64)
    marks = Shared(narrow.sparkSession, table)

    def run(batches):
        for batch in batches:
            m = batch.column(2).to_numpy().astype(np.uint64)
            kept = (marks.value[m >> np.uint64(6)] >> (m & np.uint64(63))) & np.uint64(1)
            yield batch.select(["id", "text"]).filter(pa.array(kept.astype(bool)))

    kind = narrow.schema["id"].dataType.simpleString()
    return narrow.select("id", "text", mark.alias("m")).mapInArrow(run, f"id {kind}, text string").join(ids, "id", "left_semi").dropDuplicates(["id"])


def crowds(placed: DataFrame, *more: str) -> DataFrame:
    """(id, large): one row per document in buckets of more than ``FEW``, with its list (band, key and ``more``) of these, ``BANDS`` at most.

    What belongs to a document is joined here, once, and not for each of its buckets.
    """
    return placed.where(F.col("n") > FEW).groupBy("id").agg(F.collect_list(F.struct("band", "key", *more)).alias("large"))


def finer_keys(rows: DataFrame, placed: DataFrame) -> DataFrame:
    """Rows of buckets of more than ``FEW``, with the samples that follow the band; read four times, so made once and kept."""
    extra = lambda n: F.substring("bytes", ((F.col("band") * ROWS + ROWS) % SAMPLES + 1).cast("int"), F.lit(n))
    # a key says which samples agree: those of the band, and one or two of the next band as well
    after = F.substring(F.concat("bytes", "bytes"), (F.col("band") * ROWS + ROWS + 1).cast("int"), F.lit(16))
    each = crowds(placed, "low").join(rows.select("id", "bytes"), "id").select("id", "bytes", F.explode("large").alias("b")).select("id", "bytes", "b.*")
    return settled(each.select("id", "key", "low", F.xxhash64("key", extra(1)).alias("key1"), F.xxhash64("key", extra(2)).alias("key2"), after.alias("after")))


def bucket_pairs(placed: DataFrame, large: DataFrame) -> DataFrame:
    """Candidate pairs (u > v) of representatives in their ``buckets``, the large ones with ``finer_keys``."""
    small = (placed.where(F.col("n") <= FEW).groupBy("key").agg(F.sort_array(F.collect_list("id")).alias("ids"))
             .select(F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.size("ids") - 1), lambda i: F.transform(F.slice("ids", i + 1, FEW), lambda x: F.struct(x.alias("u"), F.get("ids", i - 1).alias("v")))))).alias("p")).select("p.*"))
    pairs = small.unionByName(large.select(F.col("id").alias("u"), F.col("low").alias("v")))
    for finer in ("key1", "key2"):
        low = large.groupBy(finer).agg(F.min("id").alias("v"), F.count("*").alias("m")).where("m > 1")
        pairs = pairs.unionByName(large.select(F.col("id").alias("u"), finer).join(low, finer).select("u", "v"))
    return pairs.unionByName(neighbours(large.select("key", "after", "id"))).where("u > v").distinct()


def neighbours(large: DataFrame) -> DataFrame:
    """Pairs of documents at most ``NEIGHBOURS`` apart in their bucket, sorted by the samples after the band.

    Ranges of (bucket, samples, id) are dealt to tasks, so a bucket may spread over many of them.
    """
    def run(batches):
        keys, ids = np.zeros(0, np.int64), None
        for batch in batches:
            if not batch.num_rows:
                continue
            # the last rows of the batch before stand in front
            ids = batch.column(1) if ids is None else pa.concat_arrays([ids, batch.column(1)])
            keys = np.concatenate([keys, batch.column(0).to_numpy()])
            old = len(keys) - batch.num_rows
            for lag in range(1, NEIGHBOURS + 1):
                at = np.arange(max(old, lag), len(keys))
                at = at[keys[at] == keys[at - lag]]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), ids.take(pa.array(at - lag))], ["a", "b"])
            keys, ids = keys[-NEIGHBOURS:], ids[-NEIGHBOURS:]

    kind = large.schema["id"].dataType.simpleString()
    placed = large.repartitionByRange("key", "after", "id").sortWithinPartitions("key", "after", "id").select("key", "id")
    return placed.mapInArrow(run, f"a {kind}, b {kind}").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))


def several(placed: DataFrame) -> DataFrame:
    """(key, n, sizes, big) of the buckets of several roots, from rows (id, root, band, key, size): rows, size and most frequent root."""
    return (placed.groupBy("key", "root").agg(F.count("*").alias("c"), F.sum("size").alias("s"))
            .groupBy("key").agg(F.sum("c").alias("n"), F.sum("s").alias("sizes"), F.max(F.struct("c", "root", "s")).alias("big"))
            .where(F.col("n") > F.col("big.c")).select("key", "n", "sizes", "big"))


def parted(placed: DataFrame, mixed: DataFrame) -> DataFrame:
    """Rows (id, root, band, key, size) of the buckets in ``mixed``, as (id, band, key) with the part of the bucket that each is in.

    A bucket's rows of its most frequent root (``main``) needn't meet each other; the others meet all. Both are cut
    into parts (``pb`` and ``po`` in number) of about ``CHUNK`` rows and ``PART`` in size, and each pair of parts meets in one place.
    """
    parts = lambda c, s: F.ceil(F.greatest(c / CHUNK, s / PART)).cast("int")
    return (placed.join(mixed, "key").select("id", "band", "key", (F.col("root") == F.col("big.root")).alias("main"),
                                             parts(F.col("big.c"), F.col("big.s")).alias("pb"), parts(F.col("n") - F.col("big.c"), F.col("sizes") - F.col("big.s")).alias("po"))
            .withColumn("part", F.pmod(F.xxhash64("id"), F.when(F.col("main"), F.col("pb")).otherwise(F.col("po"))).cast("int")))


def meetings() -> Column:
    """The places of a row of ``parted``: struct (i, j, side)."""
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    # places (i, j): rows of the frequent root in part i with others in part j, or others of parts -1 - i and j
    place = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))
    part = F.col("part")
    return F.when(F.col("main"), F.transform(upto("po"), lambda o: place(part, o, F.lit(1)))).otherwise(F.concat(
        F.transform(upto("pb"), lambda b: place(b, part, F.lit(0))),
        F.transform(upto("po"), lambda o: place(-1 - F.least(part, o), F.greatest(part, o), part > o))))


def near(group: pa.RecordBatch, label: np.ndarray, least: float):
    """(r, rows whose samples are near those of row r) for rows of different labels that meet in a place.

    A pair that shares several buckets is near in the first of them only. Labels are read anew for each r.
    """
    side, band = group.column("side").to_numpy(), group.column("band")[0].as_py()
    keys = group.column("all").flatten().to_numpy().reshape(-1, BANDS)
    x = np.frombuffer(b"".join(group.column("bytes").to_pylist()), np.uint8).reshape(-1, SAMPLES)
    ones = int(side.sum())
    zeros = len(side) - ones
    one_by_one, rest = (range(zeros), (zeros, len(side))) if zeros <= ones else (range(zeros, len(side)), (0, zeros))
    if not ones:  # a part with itself
        one_by_one = range(zeros)
    for r in one_by_one:
        lo, hi = (r + 1, zeros) if not ones else rest
        at = lo + np.flatnonzero(label[lo:hi] != label[r])
        at = at[(x[at] == x[r]).mean(1) >= least]
        at = at[(keys[at] == keys[r]).argmax(1) == band]
        if len(at):
            yield r, at


def groups(batches, names: tuple[str, ...]):
    """Rows of equal ``names``, which come one after another, as one batch each."""
    held = []  # rows of the group that the last batch ended in
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        now = pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 else batch
        change = np.ones(now.num_rows, bool)
        change[1:] = False
        for c in names:
            v = now.column(c).to_numpy()
            change[1:] |= v[1:] != v[:-1]
        heads = np.flatnonzero(change)
        for s, e in zip(heads[:-1], heads[1:]):
            yield now.slice(s, e - s)
        held = [now.slice(heads[-1])]
    yield from held


class Sets:
    """Weighted shingles of some texts, numbered so that one text is compared with many at once."""

    def __init__(self, column: pa.Array, frequencies: Frequencies) -> None:
        found = [weighted(b.column(0), frequencies) for b in slices([pa.RecordBatch.from_arrays([column], ["t"])], 0, SLICE)]
        _, self.at = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
        self.level = np.concatenate([f[1] for f in found]).astype(np.int16)
        self.n = np.concatenate([np.diff(f[2]) for f in found])
        self.begin = np.concatenate([[0], np.cumsum(self.n)])
        self.total = np.array([WEIGHTS[self.level[a:b]].sum() for a, b in zip(self.begin[:-1], self.begin[1:])])
        self.one = np.zeros(int(self.at.max()) + 1 if len(self.at) else 0)

    def similarities(self, r: int, at: np.ndarray) -> np.ndarray:
        """``similarity`` of text r and each text of ``at``."""
        own = slice(self.begin[r], self.begin[r + 1])
        self.one[self.at[own]] = WEIGHTS[self.level[own]]
        out, ends, i = [], np.cumsum(self.n[at]), 0
        while i < len(at):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + (1 << 20), side="right")))
            n = self.n[at[i:j]]
            row = np.repeat(np.arange(j - i), n)
            entry = np.arange(len(row)) + np.repeat(self.begin[at[i:j]] - (np.cumsum(n) - n), n)
            there = self.one[self.at[entry]]
            both = np.bincount(row, np.minimum(there, WEIGHTS[self.level[entry]]), j - i)
            same = np.bincount(row, there > 0, j - i)
            out.append(np.maximum(both / (self.total[r] + self.total[at[i:j]] - both), same / (self.n[r] + n - same)))
            i = j
        self.one[self.at[own]] = 0
        return np.concatenate(out)


def crowded(rows: DataFrame, placed: DataFrame, root: DataFrame, narrow: DataFrame, frequencies: Shared, threshold: float) -> DataFrame:
    """Links (u > v) that join different roots, from all pairs of the buckets of more than ``FEW``.

    First the samples say which rows of a bucket are near one of another root. The texts of these meet in the
    same way and are compared where they meet. A link is given only where those before it in the same place leave
    its ends apart, so links are fewer than the rows, however many pairs are compared.
    """
    kind = rows.schema["id"].dataType.simpleString()
    least = threshold - 5 * (threshold * (1 - threshold) / SAMPLES) ** 0.5
    places = ("key", "i", "j")

    def dealt(some: DataFrame, mixed: DataFrame, what: DataFrame, *more: str) -> DataFrame:
        own = ("id", "root", "all", "bytes", *more)
        listed = parted(some, mixed).groupBy("id").agg(F.collect_list(F.struct("band", "key", "main", "pb", "po", "part")).alias("large"))
        each = listed.join(what, "id").select(*own, F.explode("large").alias("b")).select(*own, "b.*")
        return (each.select(*own, "band", "key", F.explode(meetings()).alias("p")).select(*own, "band", "key", "p.*")
                .repartition(*places).sortWithinPartitions(*places, "side").select("id", "root", *places, "side", "band", "all", "bytes", *more))

    def met(batches):
        for group in groups(batches, places):
            label = group.column("root").dictionary_encode().indices.to_numpy()
            found = np.zeros(group.num_rows, bool)
            for r, at in near(group, label, least):
                found[r] = found[at] = True
            if found.any():
                yield group.select(["id", "key"]).filter(pa.array(found))

    def linked(batches):
        for group in groups(batches, places):
            label = group.column("root").dictionary_encode().indices.to_numpy().copy()
            sets, a, b = None, [], []
            for r, at in near(group, label, least):
                sets = sets or Sets(group.column("text"), frequencies.value)
                for hit in at[sets.similarities(r, at) >= threshold]:
                    if label[hit] != label[r]:
                        label[label == label[hit]] = label[r]
                        a.append(r)
                        b.append(hit)
            if a:
                yield pa.RecordBatch.from_arrays([group.column("id").take(pa.array(a)), group.column("id").take(pa.array(b))], ["a", "b"])

    signed = settled(crowds(placed).join(root, "id", "left").join(rows, "id")
                     .select("id", F.coalesce("root", "id").alias("root"), "large", F.col("bands").alias("all"), "bytes"))
    buckets_of = lambda some: some.select("id", "root", "size", F.explode("large").alias("b")).select("id", "root", "size", "b.*")
    some = buckets_of(signed.withColumn("size", F.lit(0)))
    mixed = settled(several(some))
    close = settled(dealt(some, mixed, signed.drop("large")).mapInArrow(met, f"id {kind}, key long").groupBy("id").agg(F.collect_set("key").alias("keys")))
    release(rows.sparkSession, mixed)
    whole = settled(signed.join(close, "id").join(only(narrow, close.select("id")), "id").withColumn("size", F.octet_length("text").cast("long"))
                    .withColumn("large", F.filter("large", lambda b: F.array_contains("keys", b["key"]))).drop("keys"))
    release(rows.sparkSession, signed, close)
    some = buckets_of(whole)
    mixed = settled(several(some))
    found = dealt(some, mixed, whole.drop("large", "size"), "text").mapInArrow(linked, f"a {kind}, b {kind}")
    links = settled(found.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    release(rows.sparkSession, whole, mixed)
    return links


def estimated(pairs: DataFrame, rows: DataFrame, threshold: float) -> DataFrame:
    """Pairs with the share of agreeing samples, without those far below the threshold."""
    # a byte of two different samples agrees by chance once in 256
    error = (threshold * (1 - threshold) / SAMPLES) ** 0.5
    least = threshold - 5 * error
    sig = rows.select("id", "bytes")

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, SAMPLES) for k in (2, 3))
            share = (x == y).mean(1)
            keep = share >= least
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep)), pa.array(share[keep])], ["u", "v", "share"])

    joined = (pairs.join(sig.select(F.col("id").alias("u"), F.col("bytes").alias("a")), "u")
              .join(sig.select(F.col("id").alias("v"), F.col("bytes").alias("b")), "v").select("u", "v", "a", "b"))
    kind = pairs.schema["u"].dataType.simpleString()
    return joined.mapInArrow(run, f"u {kind}, v {kind}, share double")


def verified(pairs: DataFrame, narrow: DataFrame, frequencies: Shared, threshold: float) -> DataFrame:
    """Pairs whose weighted Jaccard similarity, from both whole texts, reaches the threshold."""
    texts = narrow.select("id", "text")
    joined = (pairs.select("u", "v").join(texts.select(F.col("id").alias("v"), F.col("text").alias("tv")), "v")
              .join(texts.select(F.col("id").alias("u"), F.col("text").alias("tu")), "u").select("u", "v", "tu", "tv"))

    def run(batches):
        for part in slices(batches, 2, SLICE):
            for batch in slices([part], 3, SLICE):
                sides = []
                for c in (2, 3):
                    s, level, begin, _ = weighted(batch.column(c), frequencies.value)
                    w = WEIGHTS[level]
                    sides.append([(s[a:b], w[a:b]) for a, b in zip(begin[:-1], begin[1:])])
                sim = np.array([similarity(a, b) for a, b in zip(*sides)])
                keep = pa.array(sim >= threshold)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array(sim[sim >= threshold])], ["u", "v", "similarity"])

    kind = pairs.schema["u"].dataType.simpleString()
    return joined.mapInArrow(run, f"u {kind}, v {kind}, similarity double")


def keyed(docs: DataFrame, key: str, *, text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, bool]:
    """``docs`` with a column ``key`` that differs wherever id or text differ: the id where all are unique, else a hash of both; and whether it is a hash.

    Rows that share a key are the same text under the same id. Rows without an id that have the same text share a key as well.
    """
    i, t = F.col(f"`{doc_id}`"), F.col(f"`{text}`")
    if docs.groupBy(i.alias("i")).agg(F.count("*").alias("n")).where("n > 1 or i is null").isEmpty():
        return docs.withColumn(key, i), False
    said = lambda c: F.coalesce(F.concat(F.lit("+"), c.cast("string")), F.lit("-"))
    return docs.withColumn(key, F.unhex(F.md5(F.concat(F.md5(said(i).cast("binary")), F.md5(said(t).cast("binary"))).cast("binary")))), True


def classes(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", threshold: float = 0.8) -> DataFrame:
    """(doc_id, class_id): one row per distinct non-null id; class_id is the least id of its near-duplicate class."""
    some = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).where("doc_id is not null")
    rows, hashed = keyed(some, "key")
    found = row_classes(rows, text="text", key="key", threshold=threshold)
    if not hashed:
        return found.select(F.col("key").alias("doc_id"), F.col("class").alias("class_id"))
    each = settled(rows.select("doc_id", "key").distinct().join(found, "key").select("doc_id", "class").distinct())
    # ids of one class, and classes of one id, belong together
    edges = each.join(each.groupBy("class").agg(F.min("doc_id").alias("low")), "class").select(F.col("doc_id").alias("u"), F.col("low").alias("v"))
    root = components(edges).select(F.col("id").alias("doc_id"), "root")
    return each.select("doc_id").distinct().join(root, "doc_id", "left").select("doc_id", F.coalesce("root", "doc_id").alias("class_id"))


def row_classes(docs: DataFrame, *, text: str, key: str, threshold: float = 0.8) -> DataFrame:
    """(key, class): one row per distinct non-null key, whose rows all have one text; class is the least key of its near-duplicate class."""
    prepare(docs.sparkSession)
    narrow = docs.select(F.col(f"`{key}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).where("id is not null")
    frequencies = document_frequencies(narrow)
    signed = signatures(narrow, frequencies)
    signed = settled(signed.groupBy("id").agg(F.min_by(F.struct("digest", "n", "bands", "bytes"), "digest").alias("s")).select("id", "s.*"))
    # equal word lists, wordless texts apart: the least id stands for all
    exact = F.when(F.col("n") > 0, F.col("digest")).otherwise(F.col("id").cast("string").cast("binary"))
    member = signed.select("id", exact.alias("d"))
    lead = member.groupBy("d").agg(F.min("id").alias("lead"))
    leads = member.join(lead, "d").groupBy("id").agg(F.min("lead").alias("lead"))
    copies = settled(leads)
    some = signed.where("n > 0").join(copies.where("id = lead").select("id"), "id", "left_semi")
    rows = settled(some.select("id", "bands", "bytes"))
    del member, lead, leads, some
    release(docs.sparkSession, signed)
    placed = buckets(rows)
    release(docs.sparkSession)
    large = finer_keys(rows, placed)
    candidates = settled(estimated(bucket_pairs(placed, large), rows, threshold))
    release(docs.sparkSession, large)
    ends = candidates.select(F.col("u").alias("id")).unionByName(candidates.select(F.col("v").alias("id"))).distinct()
    whole, narrow = narrow, settled(only(narrow, ends))  # the texts that verification needs
    best = candidates.groupBy("u").agg(F.max_by("v", F.struct("share", "v")).alias("v")).where("u is not null")
    release(docs.sparkSession)
    first = settled(verified(best, narrow, frequencies, threshold).select("u", "v"))
    release(docs.sparkSession)
    root = settled(components(first))
    at = lambda side: root.select(F.col("id").alias(side), F.col("root").alias(f"r{side}"))
    rest = (candidates.select("u", "v").join(best.select("u", "v"), ["u", "v"], "left_anti")
            .join(at("u"), "u", "left").join(at("v"), "v", "left")
            .where(F.coalesce("ru", "u") != F.coalesce("rv", "v")).select("u", "v"))
    stars = lambda r: r.select(F.col("id").alias("u"), F.col("root").alias("v"))
    joined = settled(components(stars(root).unionByName(verified(rest, narrow, frequencies, threshold).select("u", "v"))))
    del best, rest, ends
    release(docs.sparkSession, root, narrow, first)
    root = joined
    third = crowded(rows, placed, root, whole, frequencies, threshold)
    if not third.isEmpty():
        root = components(stars(root).unionByName(third))
    final = root.select(F.col("id").alias("lead"), "root")
    return (copies.join(final, "lead", "left").groupBy(F.col("id").alias("key")).agg(F.min(F.coalesce("root", "lead")).alias("class")))
