"""Similar prompts: an exact search of a query set among all rows by cosine.

Rows and queries get the nearest of some centres (cells of an index, fitted on a bounded sample).
Angles obey the triangle inequality: a row at angle a from the centre of its cell and a query at angle b from
that centre are at least |a - b| apart, so a cell's rows meet only the queries within the wanted
angle of them. What is left is compared exactly, as one matrix product per cell. No link is lost,
whatever the centres are; they decide how much is skipped.

Rows stay where they are read: there is no shuffle by cell, so a crowded cell is spread over all
tasks that read it. Queries are shipped in blocks of a bounded size; each block is one pass. Every
task hands on, per query, a count and its best ``k`` matches, never pairs.

Vectors that are null, empty, of another length than the queries, without direction (all zeros) or
hold null or non-finite entries have no cosine: such a row is no match, such a query has no
links. Repeated ids count each row; a query is not its own match (same id). Ties go to the least id.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

#: rounding of cosines in double; what the bound on angles must allow for
SLACK = 1e-7


@dataclass(frozen=True)
class Cells:
    """Centres of unit length, as rows."""

    centres: np.ndarray

    def place(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell of each row and its angle to the centre."""
        cosines = unit @ self.centres.T
        cell = cosines.argmax(axis=1)
        return cell, np.arccos(np.clip(cosines[np.arange(len(unit)), cell], -1, 1))


def given(table: DataFrame, key: str, vector: str) -> DataFrame:
    return table.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").cast("array<double>").alias("v"))


def _units(column: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors have d entries and a direction, and these at length 1."""
    fits = np.asarray(pc.fill_null(pc.equal(pc.list_value_length(column), d), False).to_numpy(zero_copy_only=False), bool)
    x = column.filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)  # null entries become NaN
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        most = np.abs(x).max(axis=1, keepdims=True)
        good = np.isfinite(most[:, 0]) & (most[:, 0] > 0)
        x = x[good] / most[good]  # so that squares neither vanish nor overflow
    fits[fits] = good
    return fits, x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def fit_cells(rows: DataFrame, d: int, *, cells: int = 256, sample_rows: int = 20_000, rounds: int = 8, seed: int = 42) -> Cells:
    """Spherical k-means on about ``sample_rows`` rows, chosen by a hash of their vectors."""
    total = rows.count()
    share = min(1.0, sample_rows / max(total, 1))
    picked = rows.where(F.pmod(F.xxhash64("v", F.lit(seed)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    # the hash picks sample_rows on average; equal vectors come together, hence the bound
    _, sample = _units(pa.array([r.v for r in picked.select("v").limit(2 * sample_rows).collect()], pa.list_(pa.float64())), d)
    if not len(sample):
        return Cells(np.eye(1, d))
    sample = np.unique(sample, axis=0)
    rng = np.random.default_rng(seed)
    centres = sample[rng.permutation(len(sample))[:max(1, min(cells, len(sample) // 4 or 1))]]
    for _ in range(rounds):
        cell, _ = Cells(centres).place(sample)
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, sample)
        norms = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.where(norms > 1e-9, sums / np.maximum(norms, 1e-9), centres)
    return Cells(centres)


#: cosines computed at once
TILE = 4_000_000


def _top(cosines: np.ndarray, hit: np.ndarray, n: int, k: int) -> np.ndarray:
    """Places of the k best hits; of equal ones the first."""
    if n <= k:
        return np.flatnonzero(hit)
    least = np.partition(cosines, -k)[-k]
    above = np.flatnonzero(cosines > least)
    return np.concatenate([above, np.flatnonzero(cosines == least)[:k - len(above)]])


def _meet(keys: pa.Array, x: np.ndarray, cells: Cells, own: dict, asked: np.ndarray, to_centres: np.ndarray, threshold: float, k: int):
    """(query, links, best k as (-cosine, key)) of the queries that a chunk of rows answers."""
    angle = float(np.arccos(np.clip(threshold, -1, 1))) + SLACK
    cell, away = cells.place(x)
    place = np.empty(len(x), np.int64)
    place[pc.array_sort_indices(keys).to_numpy(zero_copy_only=False)] = np.arange(len(x))
    order = np.lexsort((place, cell))  # by cell, within it by key
    names = keys.to_pylist()
    bounds = np.flatnonzero(np.diff(cell[order], prepend=-1, append=-1))
    count: dict[int, int] = {}
    best: dict[int, list] = {}
    for a, b in zip(bounds[:-1], bounds[1:]):
        members = order[a:b]
        reach = to_centres[:, cell[members[0]]]
        near = np.flatnonzero((reach >= away[members].min() - angle) & (reach <= away[members].max() + angle))
        mine = [(at, q) for at, r in enumerate(members.tolist()) for q in own.get(names[r], ())]
        step = max(1, TILE // len(members))
        for i in range(0, len(near), step):
            part = near[i:i + step]
            cosines = np.round(asked[part] @ x[members].T, 12)
            for at, q in mine:
                row = np.searchsorted(part, q)
                if row < len(part) and part[row] == q:
                    cosines[row, at] = -2.0
            hit = cosines >= threshold
            n = hit.sum(axis=1)
            for row in np.flatnonzero(n).tolist():
                q = int(part[row])
                count[q] = count.get(q, 0) + int(n[row])
                top = _top(cosines[row], hit[row], int(n[row]), k)
                best.setdefault(q, []).extend((-float(cosines[row, t]), names[members[t]]) for t in top.tolist())
    for q, n in count.items():
        yield q, n, sorted(best[q], key=lambda m: (m[0], m[1] is not None, m[1]))[:k]


def _block_links(rows: DataFrame, d: int, cells: Cells, ids: list, asked: np.ndarray, threshold: float, k: int, chunk_rows: int) -> DataFrame:
    """Per task and query of one block: number of links and the best k of them."""
    to_centres = np.arccos(np.clip(asked @ cells.centres.T, -1, 1))
    own: dict = {}
    for at, i in enumerate(ids):
        own.setdefault(i, []).append(at)

    def run(batches):
        for keys, x in _chunks(batches, d, chunk_rows):
            out = list(_meet(keys, x, cells, own, asked, to_centres, threshold, k))
            if out:
                kind = pa.list_(pa.struct([("cosine", pa.float64()), ("key", keys.type)]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([q for q, _, _ in out], pa.int32()), pa.array([n for _, n, _ in out], pa.int64()),
                     pa.array([[{"cosine": -c, "key": name} for c, name in top] for _, _, top in out], kind)], ["query", "links", "best"])

    key_type = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"query int, links long, best array<struct<cosine:double,key:{key_type}>>")


def _chunks(batches, d: int, chunk_rows: int):
    """Arrow batches put together, so that a cell has more than a few rows; at most ``chunk_rows`` and one batch."""
    keys, parts, n = [], [], 0
    for batch in batches:
        good, x = _units(batch.column(1), d)
        keys.append(batch.column(0).filter(pa.array(good)))
        parts.append(x)
        n += len(x)
        if n >= chunk_rows:
            yield pa.concat_arrays(keys), np.concatenate(parts)
            keys, parts, n = [], [], 0
    if n:
        yield pa.concat_arrays(keys), np.concatenate(parts)


def _best(of: Column, k: int) -> Column:
    return F.slice(F.array_sort(of, lambda a, b: F.when(a["cosine"] > b["cosine"], -1).when(a["cosine"] < b["cosine"], 1)
                                .when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)), 1, k)


def _merged(found: DataFrame, k: int) -> DataFrame:
    """Counts added up and lists cut to k per query, in two steps so that many tasks don't meet in one list."""
    for by in (["query", F.pmod(F.spark_partition_id(), F.lit(64)).alias("part")], ["query"]):
        found = found.groupBy(*by).agg(F.sum("links").alias("links"), F.flatten(F.collect_list("best")).alias("best")).select(
            "query", "links", _best(F.col("best"), k).alias("best"))
    return found


def similar(points: DataFrame, queries: DataFrame, threshold: float, *, key: str = "vec_id", vector: str = "embedding", k: int = 10,
            cells: int = 256, sample_rows: int = 20_000, block_rows: int = 50_000, chunk_rows: int = 50_000) -> DataFrame:
    """query_id, links (rows of another id at ``threshold`` or above) and the best ``k`` of them, one row per query row.

    ``k`` bounds the list that is shown, not the links that are counted. Queries go out in blocks of ``block_rows``.
    """
    spark = points.sparkSession
    asked = given(queries, key, vector)
    key_type = asked.schema["key"].dataType.simpleString()
    usual = asked.where("v is not null").groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    d = usual.d if usual else 0
    rows = given(points, key, vector).where(F.size("v") == d)
    index = fit_cells(rows, d, cells=cells, sample_rows=sample_rows) if d else Cells(np.zeros((1, 0)))
    parts: list[DataFrame] = []

    def flush(ids: list, found: list) -> None:
        names = spark.createDataFrame(list(enumerate(ids)), f"query int, query_id {key_type}")
        fits, unit = _units(pa.array(found, pa.list_(pa.float64())), d) if d else (np.zeros(len(ids), bool), None)
        good = np.flatnonzero(fits).tolist()
        if good:
            place = spark.createDataFrame(list(enumerate(good)), "query int, at int")
            links = _merged(_block_links(rows, d, index, [ids[i] for i in good], unit, threshold, k, chunk_rows), k)
            names = names.join(links.join(place, "query").drop("query").withColumnRenamed("at", "query"), "query", "left")
        else:
            names = names.withColumns({"links": F.lit(None).cast("long"), "best": F.lit(None).cast(f"array<struct<cosine:double,key:{key_type}>>")})
        parts.append(names.select("query_id", F.coalesce("links", F.lit(0)).alias("links"),
                                  F.coalesce("best", F.array().cast(f"array<struct<cosine:double,key:{key_type}>>")).alias("best")))

    ids, found = [], []
    for r in asked.toLocalIterator():  # the driver holds one block of queries at a time
        ids.append(r.key)
        found.append(r.v)
        if len(ids) == block_rows:
            flush(ids, found)
            ids, found = [], []
    if ids or not parts:
        flush(ids, found)
    return reduce(DataFrame.unionByName, parts)
