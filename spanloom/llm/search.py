"""Exact top-k search by BM25 over an inverted index with block maxima.

Each task builds indexes of the texts it reads, a shard of bounded size at a time, in groups of documents with the
same frequent words: postings by term, cut into blocks of ``BLOCK`` neighbouring documents, with the highest score of each block. Postings of
frequent terms are rows of a matrix, and one product adds them up for many queries. A query adds to the best of these sums
in each block the maxima of its other terms; a block whose bound is below the k-th best score known so far
can't hold a better document and is skipped, and so is a whole group if no wide block of it reaches that score. Documents that may be among
the best are then scored exactly. Scores use statistics of all documents, so the best k of the shards, merged, are the best k of all.

Documents are read twice for any number of queries: once for their statistics and, in two parts, for the search. One in
``FIRST`` documents is searched before all others, as the k-th best scores found there are where the others start;
what these have above it is added, so every document is compared with every query.

Queries come in blocks of bounded size (``block_queries`` queries, ``block_bytes`` of text), each of them
broadcast; a shard is indexed once, for the terms of all queries, and takes one block after another.

score = sum over query words of idf * tf (k1 + 1) / (tf + k1 (1 - b + b n / mean n)), where
idf = ln(1 + (N - df + 0.5) / (df + 0.5)); a word that a query has twice counts twice. Ties go to the
lesser id. Null, empty and wordless texts are found by no query, and as queries find nothing; documents
that share no word with a query aren't found. Rows with repeated ids are documents each, and queries
each: query rows are numbered, and every one has ranks of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .batches import prepare, slices, span_hashes, utf8, words
from .bpe import Shared
from .shared import settled

BLOCK = 2
#: One in so many documents is searched first.
FIRST = 16
SHARD_WORDS, SHARD_DOCS = 3_000_000, 1 << 14
#: Terms of at least one in ``DENSE_SHARE`` of a shard's documents have rows of scores: ``DENSE`` of them and ``CELLS`` scores at most.
DENSE, DENSE_SHARE, CELLS = 500, 32, 8 << 20
#: Terms of at least one in ``MIDDLE_SHARE``, ``MIDDLE`` of them at most, have rows of block maxima.
MIDDLE, MIDDLE_SHARE = 500, 128
#: More than the relative error of sums of 3000 positive float32 numbers.
SLACK = 5e-4
#: A shard of ``GROUPED`` documents or more is indexed in ``GROUPS`` groups of documents with the same frequent words, of which ``FEATURES`` count.
GROUPED, GROUPS, FEATURES, ASIDE = 1024, 4, 256, 16
#: Documents of the wide blocks by which whole queries are skipped.
WIDE = 64
NONE = (np.zeros(0, np.int64),)
#: Queries and sums of one matrix product, and entries of rarer terms that are added up at once.
TOGETHER, SUMS, ENTRIES = 256, 1 << 21, 1 << 17
K1, B = 1.2, 0.75


def terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = utf8(column)
    low, starts, ends, first = words(data, offsets)
    return span_hashes(low, starts, ends), first


class Terms:
    """All terms of the queries: their hashes, sorted, and the number each got when it was met first, which queries refer to; then their weights."""

    def __init__(self) -> None:
        self.terms, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.idf, self.mean = np.zeros(0), 1.0
        self.indexed()

    def __len__(self) -> int:
        return len(self.number)

    def indexed(self) -> None:
        """Where hashes with the same first bits begin: a search looks at one or two of them, not at twenty."""
        bits = max(1, min(24, len(self.terms).bit_length()))
        self.shift = np.uint64(64 - bits)
        self.start = np.searchsorted(self.terms >> self.shift, np.arange(1 << bits, dtype=np.uint64)).astype(np.int32)

    def add(self, h: np.ndarray) -> None:
        hit, _ = self.known(h)
        new = np.unique(h[~hit])
        hashes, number = np.append(self.terms, new), np.append(self.number, np.arange(len(self), len(self) + len(new), dtype=np.int32))
        order = np.argsort(hashes)
        self.terms, self.number = hashes[order], number[order]
        self.indexed()

    def known(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are query terms, and their places in the order of hashes, by which scores are added up."""
        if not len(self):
            return np.zeros(len(h), bool), np.zeros(0, np.int64)
        last = len(self) - 1
        at = np.minimum(self.start[h >> self.shift], last)
        left = np.flatnonzero(self.terms[at] < h)
        while len(left):
            at[left] += 1
            left = left[at[left] <= last]
            left = left[self.terms[at[left]] < h[left]]
        at = np.minimum(at, last)
        hit = self.terms[at] == h
        return hit, at[hit]

    def postings(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, place of the term, count) of the known words of some texts, by text and term."""
        hit, t = self.known(h)
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))[hit]
        pair, count = np.unique(row * max(len(self), 1) + t, return_counts=True)
        row = pair // max(len(self), 1)
        return row, pair - row * max(len(self), 1), count


class Queries:
    """A block of queries, numbered from ``start`` on: their ids, and per query its term numbers and counts. Terms are its own, unless it shares those of more blocks."""

    def __init__(self, rows: list[tuple[object, str]], shared: Terms | None = None, start: int = 0) -> None:
        self.ids, self.start = [i for i, _ in rows], start
        h, first = terms(pa.array([t for _, t in rows], pa.string()))
        of = Terms() if shared is None else shared
        of.add(h)
        row, term, count = of.postings(h, first)
        self.term, self.count = of.number[term], count.astype(np.int32)
        self.first = np.searchsorted(row, np.arange(len(rows) + 1))
        if shared is None:
            self.terms, self.number, self.known, self.idf, self.mean = of.terms, of.number, of.known, of.idf, of.mean

    @property
    def parts(self) -> list[tuple[np.ndarray, np.ndarray]]:
        return [(self.term[a:b], self.count[a:b]) for a, b in zip(self.first[:-1], self.first[1:])]


def spans(a: np.ndarray, n: np.ndarray) -> np.ndarray:
    """a, a + 1, ... of n numbers each, one after another."""
    return np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())


def alike(term: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """A group for each document, by the frequent words it has (such as those of its language): spherical k-means, seeded by what is least like the seeds so far.

    Any groups give the same results; a query skips those whose words are not its own.
    """
    if n < GROUPED:
        return np.zeros(n, np.int64)
    df = np.bincount(term)
    often = np.argsort(-df, kind="stable")[:FEATURES]
    place = np.full(len(df), -1)
    place[often] = np.arange(len(often))
    at = np.flatnonzero(place[term] >= 0)
    has = np.zeros((n, len(often)), np.float32)
    has[doc[at], place[term[at]]] = np.sqrt(np.log1p(n / df[term[at]]))
    sizes = np.count_nonzero(has, axis=1)
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-9)
    has = unit(has)
    best = np.where(sizes >= np.median(sizes), has @ unit(has.mean(0)), np.inf)
    seeds = []
    for _ in range(GROUPS):
        like = has @ has[np.argmin(best)]
        seeds.append(unit(has[np.argsort(-like, kind="stable")[:max(1, n >> 6)]].mean(0)))
        best = np.maximum(best, has @ seeds[-1])
    centres = np.array(seeds)
    for _ in range(4):
        group = np.argmax(has @ centres.T, axis=1)
        centres = unit((group == np.arange(GROUPS)[:, None]).astype(np.float32) @ has)
    like = np.max(has @ centres.T, axis=1)
    group[like < np.partition(like, n // ASIDE)[n // ASIDE]] = GROUPS  # a few that are like no other would lend a whole group their words
    return group


class Maxima:
    """The highest score of each term in every block of ``size`` neighbouring documents: rows of a matrix for the terms ``rows``, postings for the others."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, score: np.ndarray, rows: np.ndarray, terms: int, docs: int, size: int) -> None:
        self.blocks, block = -(-docs // size), doc // size
        change = np.ones(len(term), bool)
        change[1:] = (term[1:] != term[:-1]) | (block[1:] != block[:-1])
        heads = np.flatnonzero(change)
        self.block, self.max = block[heads], np.maximum.reduceat(score, heads) if len(heads) else np.zeros(0)
        self.first = np.searchsorted(term[heads], np.arange(terms + 1))
        self.row, self.table = tabled(rows, terms, term[heads], self.block, self.max, self.blocks)

    def added(self, t: np.ndarray, count: np.ndarray, asker: np.ndarray, n: int) -> np.ndarray:
        """For n queries the sums of the maxima of their terms, by block."""
        out = product(self.row, self.table, t, count, asker, n)
        at = np.flatnonzero(self.row[t] < 0)
        t, count, asker = t[at], count[at], asker[at]
        size = self.first[t + 1] - self.first[t]
        ends = np.cumsum(np.bincount(asker, weights=size, minlength=n))
        a = 0
        while a < n:
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + ENTRIES, side="right")))
            part = slice(*np.searchsorted(asker, [a, b]))
            m, entry = size[part], spans(self.first[t[part]], size[part])
            cell = self.block[entry] + np.repeat((asker[part] - a) * self.blocks, m)
            out[a:b] += np.bincount(cell, weights=self.max[entry] * np.repeat(count[part], m), minlength=(b - a) * self.blocks).reshape(b - a, -1)
            a = b
        return out


def tabled(rows: np.ndarray, terms: int, term: np.ndarray, column: np.ndarray, value: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The row of each term (-1: none), and the rows."""
    row = np.full(terms, -1, np.int32)
    row[rows] = np.arange(len(rows))
    table = np.zeros((len(rows), width), np.float32)
    at = np.flatnonzero(row[term] >= 0)
    table[row[term[at]], column[at]] = value[at]
    return row, table


def product(row: np.ndarray, table: np.ndarray, t: np.ndarray, count: np.ndarray, asker: np.ndarray, n: int) -> np.ndarray:
    """For n queries the sums of the rows of their terms."""
    at = np.flatnonzero(row[t] >= 0)
    asked = np.zeros((n, len(table)), np.float32)
    asked[asker[at], row[t[at]]] = count[at]
    return asked @ table


class Shard:
    """Inverted index of some texts, for the terms of all queries. Postings come by document and term with their counts, or as words."""

    def __init__(self, q: Terms | Queries, ids: list | np.ndarray, term: np.ndarray, doc: np.ndarray, length: np.ndarray, tf: np.ndarray | None = None) -> None:
        self.ids, docs = np.asarray(ids), len(ids)
        if tf is None:
            pair, tf = np.unique(doc.astype(np.int64) * max(len(q.terms), 1) + term, return_counts=True)
            doc, term = pair // max(len(q.terms), 1), pair % max(len(q.terms), 1)
        norm = K1 * (1 - B + B * length / q.mean)
        # terms that stand here have numbers of their own, in the same order
        here = np.flatnonzero(np.bincount(term, minlength=len(q.terms)))
        own = np.full(len(q.terms), -1, np.int32)
        own[here] = np.arange(len(here), dtype=np.int32)
        idf, term, terms = q.idf[here], own[term], len(here)
        self.here = np.empty_like(own)
        self.here[q.number] = own
        # postings by document, to score a few documents exactly
        self.doc_term, self.doc_score = term, idf[term] * tf * (K1 + 1) / (tf + norm[doc])
        self.of_doc = np.append(0, np.cumsum(np.bincount(doc, minlength=docs)))
        self.weight, self.asked = np.zeros(terms), np.zeros(terms, bool)
        by_term = np.argsort(term, kind="stable")
        term, doc, score = term[by_term], doc[by_term], self.doc_score[by_term]
        # terms of many documents have a row of scores each, which one matrix product adds up for many queries; less frequent ones a row of block maxima
        df = np.bincount(term, minlength=terms)
        order = np.argsort(-df, kind="stable")[:DENSE + MIDDLE]
        often = order[:min(DENSE, CELLS // max(docs, 1))]
        often = often[df[often] * DENSE_SHARE >= max(docs, 1)]
        some = order[len(often):][:MIDDLE]
        some = some[df[some] * MIDDLE_SHARE >= max(docs, 1)]
        self.near = Maxima(term, doc, score, some, terms, docs, BLOCK)
        self.far = Maxima(term, doc, score, order[:len(often) + len(some)], terms, docs, WIDE)
        self.top = np.maximum.reduceat(self.far.max, self.far.first[:-1]) if terms else np.zeros(0)
        # the first documents of all blocks, then the second ones: maxima of blocks are maxima of whole rows
        self.blocks = self.near.blocks
        self.row, self.table = tabled(often, terms, term, doc % BLOCK * self.blocks + doc // BLOCK, score, BLOCK * self.blocks)
        self.doc, self.score, self.of_term, self.place = doc, score, np.append(0, np.cumsum(df)), np.full(docs, -1)

    def sums(self, parts: list[tuple[np.ndarray, np.ndarray]], k: int = 10, floors: np.ndarray | None = None):
        """Per query its part, and the documents that may reach its floor with the most they can have and what frequent terms give them. Floors not known yet are set."""
        floors = np.zeros(len(parts)) if floors is None else floors
        many = max(1, min(TOGETHER, SUMS // max(self.table.shape[1], 1)))
        for low in range(0, len(parts), 2 * TOGETHER):
            some, floor = parts[low:low + 2 * TOGETHER], floors[low:low + 2 * TOGETHER]
            t, count = (np.concatenate(x) for x in zip(*some))
            t = self.here[t]
            at = np.flatnonzero(t >= 0)
            t, count, asker = t[at], count[at], np.repeat(np.arange(len(some)), [len(x) for x, _ in some])[at]
            reach = np.bincount(asker, weights=self.top[t] * count, minlength=len(some))
            awake = (reach > 0) & (reach * (1 + SLACK) >= floor)

            def of(which: np.ndarray):
                at = np.flatnonzero(which[asker])
                return t[at], count[at], (np.cumsum(which) - 1)[asker[at]]

            # queries that may reach their floor by maxima of different places only
            doubt = awake & (reach < 2 * floor)
            if doubt.any():
                awake[doubt] = self.far.added(*of(doubt), int(doubt.sum())).max(1) * (1 + SLACK) >= floor[doubt]
            who, (t, count, asker) = np.flatnonzero(awake), of(awake)
            out = [NONE] * len(some)
            for i in range(0, len(who), many):
                part = slice(*np.searchsorted(asker, [i, i + many]))
                for j, *found in self.near_floor(who[i:i + many], t[part], count[part], asker[part] - i, k, floor):
                    out[j] = found
            yield from zip(some, out)

    def near_floor(self, who: np.ndarray, t: np.ndarray, count: np.ndarray, asker: np.ndarray, k: int, floors: np.ndarray):
        """(query, documents, bounds, sums, its terms that stand here, counts) of the queries ``who`` that have such documents."""
        sums = product(self.row, self.table, t, count, asker, len(who))
        new = np.flatnonzero(floors[who] <= 0)
        if len(new) and len(self.ids) >= k:
            least = sums.shape[1] - k
            floors[who[new]] = np.partition(sums[new], least, axis=1)[:, least] * (1 - SLACK)  # the k-th best score is no less
        floor = floors[who]
        # what frequent terms give is known per document, rarer ones add the maxima of their blocks
        rare = np.flatnonzero(self.row[t] < 0)
        more = self.near.added(t[rare], count[rare], asker[rare], len(who))
        sums = sums.reshape(len(who), BLOCK, self.blocks)
        most = sums.max(1) + more
        of, block = np.nonzero((most > 0) & (most * (1 + SLACK) >= floor[:, None]))
        sums = sums[of, :, block]
        most = sums + more[of, block][:, None]
        c, place = np.nonzero((most > 0) & (most * (1 + SLACK) >= floor[of][:, None]) & (block[:, None] * BLOCK + np.arange(BLOCK) < len(self.ids)))
        of, doc, most, sums = of[c], block[c] * BLOCK + place, most[c, place], sums[c, place]
        edges = np.append(np.flatnonzero(np.diff(of, prepend=-1)), len(of))
        first = np.searchsorted(asker, np.arange(len(who) + 1))
        for a, b in zip(edges[:-1], edges[1:]):
            part = slice(first[of[a]], first[of[a] + 1])
            yield who[of[a]], doc[a:b], most[a:b], sums[a:b], t[part], count[part]

    def exact(self, docs: np.ndarray, t: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Scores of some documents, terms (by their numbers here) added up in order, so that equal documents have equal scores."""
        self.weight[t], self.asked[t] = count, True
        cuts = list(zip(self.of_doc[docs].tolist(), self.of_doc[docs + 1].tolist()))
        term, score = (np.concatenate([x[a:b] for a, b in cuts]) for x in (self.doc_term, self.doc_score))
        hit = np.flatnonzero(self.asked[term])
        of = np.searchsorted(np.cumsum([b - a for a, b in cuts]), hit, side="right")
        out = np.bincount(of, weights=score[hit] * self.weight[term[hit]], minlength=len(docs))
        self.asked[t] = False
        return out

    def about(self, docs: np.ndarray, sums: np.ndarray, t: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Scores of some documents, but for the order of adding: their sums and the postings of rarer terms ``t``."""
        n = self.of_term[t + 1] - self.of_term[t]
        self.place[docs] = np.arange(len(docs))
        at = spans(self.of_term[t], n)
        place = self.place[self.doc[at]]
        hit = np.flatnonzero(place >= 0)
        self.place[docs] = -1
        return sums + np.bincount(place[hit], weights=self.score[at[hit]] * np.repeat(count, n)[hit], minlength=len(docs))

    def best(self, part: tuple[np.ndarray, np.ndarray], sums: tuple[np.ndarray, ...], k: int, floor: float) -> tuple[np.ndarray, np.ndarray, float]:
        """(documents, scores) that may be among the best k, and the least score that still may. Documents are scored in the order of their bounds."""
        doc, most, sums, t, count = sums
        rare = self.row[t] < 0
        if (self.of_doc[doc + 1] - self.of_doc[doc]).sum() > (self.of_term[t[rare] + 1] - self.of_term[t[rare]]).sum():
            most = self.about(doc, sums, t[rare], count[rare])
            if len(most) >= k:
                floor = max(floor, np.partition(most, len(most) - k)[len(most) - k] * (1 - SLACK))
            may = most * (1 + SLACK) >= floor
            doc, most = doc[may], most[may]
        queue, step, d, s = np.argsort(-most, kind="stable"), 4 * k, np.zeros(0, np.int64), np.zeros(0)
        while len(queue):
            some = doc[queue[:step]]
            d, s = np.append(d, some), np.append(s, self.exact(some, t, count))
            if len(s) >= k:
                floor = max(floor, np.partition(s, len(s) - k)[len(s) - k])
            queue = queue[step:]
            queue = queue[most[queue] * (1 + SLACK) >= floor]
            step *= 4
        keep = (s > 0) & (s >= floor)
        return d[keep], s[keep], floor


def ranked(rows: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query row."""
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "doc_id"))
    return rows.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def part_search(narrow: DataFrame, weighted: Shared, blocks: list[Shared], k: int, floors: Shared) -> DataFrame:
    """(q, query_id, doc_id, score): of each shard and query the best k that are no worse than the query's floor."""

    def searched(batches):
        known, floor = weighted.value, floors.value.copy()

        def answers(held):
            if not held[0]:
                return
            term, doc, tf, length = map(np.concatenate, held[1:])
            names, order = pa.array(held[0], kind), np.unique(np.array(held[0]), return_inverse=True)[1]
            group = alike(term, doc, len(names))
            shards = []
            for g in np.unique(group):
                docs = np.flatnonzero(group == g)
                place = np.full(len(names), -1, np.int32)
                place[docs] = np.arange(len(docs))
                at = np.flatnonzero(place[doc] >= 0)
                shards.append(Shard(known, docs, term[at], place[doc[at]], length[docs], tf[at]))
            for block in blocks:
                q = block.passing()
                rows_q, rows_d, rows_s = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
                own = floor[q.start:q.start + len(q.ids)]
                for shard in shards:
                    for i, (part, sums) in enumerate(shard.sums(q.parts, k, own)):
                        if len(sums[0]):
                            d, s, own[i] = shard.best(part, sums, k, own[i])
                            top = np.lexsort((order[shard.ids[d]], -s))[:k]
                            rows_q.append(np.full(len(top), i))
                            rows_d.append(shard.ids[d[top]])
                            rows_s.append(s[top])
                of = np.concatenate(rows_q)
                yield pa.RecordBatch.from_arrays([pa.array(of + q.start, pa.int64()), pa.array(q.ids, kind).take(pa.array(of)), names.take(pa.array(np.concatenate(rows_d))), pa.array(np.concatenate(rows_s))],
                                                 ["q", "query_id", "doc_id", "score"])

        held, size, kind = ([], [], [], [], []), 0, None
        for batch in slices(batches):
            kind = batch.schema.field(0).type
            h, first = terms(batch.column(1))
            row, term, tf = known.postings(h, first)
            for into, some in zip(held[1:], (term.astype(np.int32), (row + len(held[0])).astype(np.int32), tf.astype(np.int32), np.diff(first))):
                into.append(some)
            held[0].extend(batch.column(0).to_pylist())
            size += len(term)
            if size > SHARD_WORDS or len(held[0]) >= SHARD_DOCS:
                yield from answers(held)
                held, size = ([], [], [], [], []), 0
        yield from answers(held)

    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(searched, f"q long, query_id {kind}, doc_id {kind}, score double")


def search(docs: DataFrame, queries: DataFrame, *, k: int = 10, text: str = "text", doc_id: str = "doc_id", block_queries: int = 4096, block_bytes: int = 32 << 20) -> DataFrame:
    """query_id, rank, doc_id, score: the k best documents of every row of ``queries`` (same columns)."""
    spark = prepare(docs.sparkSession)
    pick = lambda d: d.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).where("doc_id is not null")
    narrow = pick(docs)

    known, blocks, rows, held, number = Terms(), [], [], 0, 0
    for r in pick(queries).toLocalIterator():
        rows.append((r.doc_id, r.text))
        held += len(r.text)
        if len(rows) >= block_queries or held >= block_bytes:
            blocks.append(Shared(spark, Queries(rows, known, number)))
            number += len(rows)
            rows, held = [], 0
    if rows:
        blocks.append(Shared(spark, Queries(rows, known, number)))
        number += len(rows)
    plain = Shared(spark, known)

    def counted(batches):
        known = plain.value
        total, n, length = np.zeros(len(known), np.int64), 0, 0
        for batch in slices(batches):
            h, first = terms(batch.column(1))
            n, length = n + batch.num_rows, length + len(h)
            total += np.bincount(known.postings(h, first)[1], minlength=len(total))
        at = np.flatnonzero(total)
        # below the terms stand the numbers of documents, words and tasks
        yield pa.RecordBatch.from_arrays([pa.array(np.append([-1, -2, -3], at)), pa.array(np.append([n, length, n > 0], total[at]))], ["t", "df"])

    found = narrow.mapInArrow(counted, "t long, df long").groupBy("t").agg(F.sum("df").alias("df")).toArrow()
    t, df = found.column("t").to_numpy(), found.column("df").to_numpy()
    documents, length, tasks = (int(df[t == x].sum()) for x in (-1, -2, -3))
    in_docs = np.zeros(len(known))
    in_docs[t[t >= 0]] = df[t >= 0]
    known.idf, known.mean = np.log1p((documents - in_docs + 0.5) / (in_docs + 0.5)), length / max(documents, 1) or 1.0
    weighted = Shared(spark, known)

    early = F.expr(f"pmod(xxhash64(doc_id), {FIRST}) = 0")
    few = narrow.where(early).coalesce(max(1, min(tasks, max(spark.sparkContext.defaultParallelism, tasks // FIRST))))
    first = settled(ranked(part_search(few, weighted, blocks, k, Shared(spark, np.zeros(number))), k).drop("rank"))
    floors = np.zeros(number)
    kth = first.groupBy("q").agg(F.count("*").alias("n"), F.min("score").alias("score")).where(F.col("n") >= k).toArrow()
    floors[kth.column("q").to_numpy()] = kth.column("score").to_numpy()
    rest = part_search(narrow.where(~early), weighted, blocks, k, Shared(spark, floors))
    return ranked(first.unionByName(rest), k).select("query_id", "rank", "doc_id", "score")
