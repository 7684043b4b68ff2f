"""Benchmark decontamination with Wu-Manber search over words.

The test strings are all windows of 13 consecutive words of the benchmark items (an item of
fewer words is one window). Strings of one length m share a shift table: a block of the last
few words of the place looked at says how far the search may jump, because no string has that
block nearer to its end. Where the jump is 0, the hash of the suffix block selects a bucket of
test strings, and these are compared with the text word by word, then byte by byte.

Many places are looked at in step: every text is cut into runs of end positions, and one
vectorised step moves the cursor of each run by its own shift.

Null texts have no words; empty texts have none either and are clean. Items without words
never occur. Items without an id count as hits like all others; together they are one item, a null
in the list of items (as in ``REPORT_SQL``). Repeated rows are judged each for itself. The benchmark is
broadcast in blocks of at most ``max_benchmark_bytes`` of text, one pass over the documents for each, and
covered words add up; only a single item above that size is refused with an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .batches import carried, mixed, prepare, slices, span_hashes, utf8, words
from .bpe import Shared
from .shared import settled

RUN = 256
SLICE = 1 << 20


class Strings:
    """Test strings of one length, with shift table and suffix buckets."""

    def __init__(self, patterns: np.ndarray, spans: list[list[bytes]], owners: list[list[int]]) -> None:
        self.m = m = patterns.shape[1]
        self.patterns, self.spans, self.owners = patterns, spans, owners
        self.block = b = min(m, 3)
        bits = max(12, int(np.ceil(np.log2(max(2, patterns.size)))) + 3)
        self.down = np.uint64(64 - bits)
        self.shift = np.full(1 << bits, m - b + 1, np.int16)
        for end in range(b, m + 1):
            key = self.key(patterns[:, :end].T)
            np.minimum.at(self.shift, key, m - end)
        last = self.key(patterns.T)
        order = np.argsort(last, kind="stable")
        self.order = order
        self.bucket = np.concatenate([[0], np.cumsum(np.bincount(last, minlength=1 << bits))])

    def key(self, columns) -> np.ndarray:
        """Hash of the last ``block`` words; ``columns[-1]`` is the last word."""
        h = columns[-1]
        with np.errstate(over="ignore"):
            for j in range(2, self.block + 1):
                h = h * np.uint64(0xD6E8FEB86659FD93) + columns[-j]
        return (mixed(h) >> self.down).astype(np.int64)

    def search(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(end position, pattern) of word-hash matches."""
        m, n = self.m, np.diff(first)
        begin, stop = first[:-1] + m - 1, first[1:]
        runs = np.maximum(0, -(-(stop - begin) // RUN))
        pos = np.repeat(begin, runs) + RUN * (np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs))
        end = np.minimum(pos + RUN, np.repeat(stop, runs))
        ends, keys = [], []
        while len(pos):
            key = self.key([h[pos - j] for j in range(self.block - 1, -1, -1)])
            jump = self.shift[key]
            hit = jump == 0
            if hit.any():
                ends.append(pos[hit])
                keys.append(key[hit])
            pos = pos + np.maximum(jump, 1)
            go = pos < end
            pos, end = pos[go], end[go]
        if not ends:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        ends, keys = np.concatenate(ends), np.concatenate(keys)
        count = self.bucket[keys + 1] - self.bucket[keys]
        at = np.repeat(ends, count)
        which = self.order[np.repeat(self.bucket[keys], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
        for j in range(m):
            same = h[at - j] == self.patterns[which, m - 1 - j]
            at, which = at[same], which[same]
        return at, which


class Benchmark:
    def __init__(self, items: list[tuple[str | None, str]], window: int) -> None:
        self.items = [i for i, _ in items]
        data, offsets = utf8(pa.array([t for _, t in items], pa.string()))
        low, starts, ends, first = words(data, offsets)
        h = span_hashes(low, starts, ends)
        found: dict[int, dict[tuple[bytes, ...], tuple[np.ndarray, list[int]]]] = {}
        for i in range(len(items)):
            a, b = int(first[i]), int(first[i + 1])
            m = min(window, b - a)
            if not m:
                continue
            text = [low[s:e].tobytes() for s, e in zip(starts[a:b], ends[a:b])]
            for j in range(b - a - m + 1):
                owners = found.setdefault(m, {}).setdefault(tuple(text[j:j + m]), (h[a + j:a + j + m], []))[1]
                if not owners or owners[-1] != i:
                    owners.append(i)
        self.strings = [Strings(np.array([v[0] for v in group.values()]), [list(k) for k in group], [v[1] for v in group.values()]) for _, group in sorted(found.items())]

    def scan(self, column: pa.Array, covers: list[list[int]], known: list[list[str | None]]) -> tuple[np.ndarray, np.ndarray, list[list[str | None]], np.ndarray, np.ndarray]:
        """Per text: words, words inside an occurrence, items that occur; which words are inside, first word of each text.

        ``covers`` (start, end, start, ... of covered words) and ``known`` items of each text, if not empty, count as well.
        """
        data, offsets = utf8(column)
        low, starts, ends, first = words(data, offsets)
        h = span_hashes(low, starts, ends)
        cover = np.zeros(len(h) + 1, np.int64)
        items: list[set[str | None]] = [set(x) for x in known] or [set() for _ in range(len(offsets) - 1)]
        for r, c in enumerate(covers):
            cover[first[r] + np.array(c[::2], np.int64)] += 1
            np.subtract.at(cover, first[r] + np.array(c[1::2], np.int64), 1)
        for group in self.strings:
            at, which = group.search(h, first)
            row = np.searchsorted(first, at, side="right") - 1
            for e, p, r in zip(at.tolist(), which.tolist(), row.tolist()):
                b = e - group.m + 1
                if all(low[starts[b + j]:ends[b + j]].tobytes() == w for j, w in enumerate(group.spans[p])):
                    cover[b] += 1
                    cover[e + 1] -= 1
                    items[r].update(self.items[o] for o in group.owners[p])
        inside = np.cumsum(cover[:-1]) > 0
        hit = np.concatenate([[0], np.cumsum(inside)])
        return np.diff(first), hit[first[1:]] - hit[first[:-1]], [sorted(x, key=lambda i: (i is None, i or "")) for x in items], inside, first


def contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = 13, share: int = 20, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
                  item_id: str = "item_id", item_text: str = "text", max_benchmark_bytes: int = 256 << 20) -> DataFrame:
    """``keep`` columns, n_words, n_hit, items (ids of occurring items as text), contaminated."""
    spark = prepare(docs.sparkSession)
    tests = benchmark.select(F.col(f"`{item_id}`").cast("string").alias("i"), F.col(f"`{item_text}`").alias("t")).where("t is not null")
    widest = tests.agg(F.coalesce(F.max(F.octet_length("t")), F.lit(0))).first()[0]
    if widest > max_benchmark_bytes:
        raise ValueError(f"a benchmark item has {widest} bytes of text; max_benchmark_bytes is {max_benchmark_bytes}")
    narrow, at, schema = carried(docs, keep, text)
    block, held, later = [], 0, False
    for r in tests.toLocalIterator():
        n = len(r.t.encode("utf-8", "surrogatepass"))
        if block and held + n > max_benchmark_bytes:
            narrow, later = settled(_marked(narrow, at, block, window, later)), True
            block, held = [], 0
        block.append((r.i, r.t))
        held += n
    shared = Shared(spark, Benchmark(_ordered(block), window))

    def run(batches):
        tests = shared.value
        for batch in slices(batches, at, SLICE):
            n, hit, items, _, _ = tests.scan(batch.column(at), *_before(batch, later))
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], pa.array(n.astype(np.int64)), pa.array(hit.astype(np.int64)), pa.array(items, pa.list_(pa.string())), pa.array((hit > 0) & (share * hit >= n))],
                                             [*keep, "n_words", "n_hit", "items", "contaminated"])

    return narrow.mapInArrow(run, f"{schema}, n_words long, n_hit long, items array<string>, contaminated boolean")


def _ordered(items: list[tuple[str | None, str]]) -> list[tuple[str | None, str]]:
    return sorted(items, key=lambda x: (x[0] is None, x[0] or "", x[1]))


def _before(batch: pa.RecordBatch, later: bool) -> tuple[list, list]:
    """Covered words and items of the blocks before, which are the last two columns."""
    return (batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()) if later else ([], [])


def _marked(narrow: DataFrame, at: int, block: list[tuple[str | None, str]], window: int, later: bool) -> DataFrame:
    """``narrow`` with the words that one block of the benchmark, and those before it, cover, and their items."""
    shared = Shared(narrow.sparkSession, Benchmark(_ordered(block), window))
    fields = narrow.schema.fields[:-2] if later else narrow.schema.fields
    names, width = [f.name for f in fields] + ["__cover", "__items"], len(fields)

    def run(batches):
        tests = shared.value
        for batch in slices(batches, at, SLICE):
            _, _, items, inside, first = tests.scan(batch.column(at), *_before(batch, later))
            covers = [np.flatnonzero(np.diff(np.concatenate([[0], inside[a:b].astype(np.int8), [0]]))).tolist() for a, b in zip(first[:-1], first[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(covers, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))], names)

    return narrow.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", __cover array<long>, __items array<string>")


def report(found: DataFrame) -> DataFrame:
    """The flat form: number of items and a digest of their ids."""
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


#: The same report in SQL, for the tables documents and benchmark.
REPORT_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
iw AS (SELECT item_id, least(13, len(ws)) AS m, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS p, ws FROM i WHERE len(ws) > 0),
pat AS (SELECT DISTINCT item_id, m, array_to_string(ws[p:p + m - 1], ' ') AS s FROM iw),
ms AS (SELECT DISTINCT m FROM pat),
dw AS (SELECT doc_id, m, ws, unnest(range(1, len(ws) - m + 2)) AS p FROM w, ms WHERE len(ws) >= m),
hits AS (SELECT d.doc_id, d.p, d.m, pat.item_id FROM (SELECT doc_id, p, m, array_to_string(ws[p:p + m - 1], ' ') AS s FROM dw) d JOIN pat USING (m, s)),
cov AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + m)) AS x FROM hits) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY 1)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""
