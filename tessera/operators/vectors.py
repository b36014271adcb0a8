"""A partitioned vector index: lists around centroids, probed by share, scored exactly.

Centroids are fitted on a bounded, hashed sample, in two levels: coarse groups first, then the lists of each group alone.
Every vector is put into the list of its nearest centroid. Neighbouring lists are laid together in pieces of bounded size
(a longer list is cut), and queries are dealt to blocks of bounded size: a query is sent to the pieces that hold a list that
it probes, and pieces and queries meet by key (piece, block), never in a nested loop. A whole piece is scored: single
precision rules out what cannot be among the k nearest, the rest is scored in double.

How many lists must be probed depends on the data, so it is measured: for a bounded sample of vectors the true
neighbours are found in all lists, and the least share of vectors that holds `target` of them is stored with the index. With
exact=True the first round probes no more than the least share, and a second one the lists that could still hold a nearer
vector, by the triangle inequality of angles against each list's radius; the result is then that of a full scan.

Rows without a vector are not indexed; a zero vector is at distance 1 of everything; ties go by id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import written
from tessera.sources.tables import spread

#: Vectors of a leaf and the share of them that is searched, as the index of trials is set up.
LEAF, SHARE = 500, 0.07
_PIECE = 16_384  # vectors of a piece and queries of a block
_CELLS = 2**20  # numbers of a matrix that a task holds at once


def _unit(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norm > 0, norm, 1.0)


def _matrix(column: pa.Array) -> np.ndarray:
    """The unit vectors of a list column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return _unit(np.asarray(column.flatten(), np.float64).reshape(len(column), -1)) if len(column) else np.zeros((0, 1))


def _slices(n: int, width: int) -> Iterator[slice]:
    """Rows 0 to n, so many at once that a matrix of `width` columns stays bounded."""
    step = max(1, _CELLS // max(1, width))
    return (slice(low, low + step) for low in range(0, n, step))


def _nearest(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The centroid nearest to each row, and its angle."""
    found, angle = np.zeros(len(rows), np.int32), np.zeros(len(rows))
    for part in _slices(len(rows), len(centroids)):
        dots = rows[part] @ centroids.T
        found[part] = dots.argmax(1)
        angle[part] = np.arccos(np.clip(dots[np.arange(len(dots)), found[part]], -1, 1))
    return found, angle


def _fitted(rows: np.ndarray, lists: int, seed: int, steps: int = 5) -> np.ndarray:
    """At most `lists` centroids of unit rows, by a few rounds of spherical k-means."""
    rows = np.unique(rows, axis=0)
    centroids = rows[np.random.default_rng(seed).permutation(len(rows))[:lists]]
    for _ in range(steps if len(centroids) < len(rows) else 0):
        near, _ = _nearest(rows, centroids)
        order = np.argsort(near, kind="stable")
        held, first = np.unique(near[order], return_index=True)
        centroids = centroids.copy()
        centroids[held] = _unit(np.add.reduceat(rows[order], first, axis=0))
    return centroids


def _best(vectors: np.ndarray, asked: np.ndarray, reach: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, distance): the k unit vectors nearest to each unit query, none beyond its reach; ties go to earlier vectors."""
    kind, copy = np.unique(vectors.view(np.dtype((np.void, vectors.dtype.itemsize * vectors.shape[1]))).ravel(), return_inverse=True)[1], np.zeros(len(vectors), np.int64)
    order = np.argsort(kind, kind="stable")
    starts = np.flatnonzero(np.diff(kind[order], prepend=-1))
    copy[order] = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    kept = np.flatnonzero(copy < k)  # of equal vectors only the first k can be found
    vectors = vectors[kept]
    narrow, slack = vectors.astype(np.float32), 4e-7 * (vectors.shape[1] + 8)  # more than single precision can be wrong
    out = []
    for low in range(0, len(asked), 256):
        q, far = asked[low : low + 256], reach[low : low + 256].copy()
        row, at, distance = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for start in range(0, len(vectors), 4096):
            dots = q.astype(np.float32) @ narrow[start : start + 4096].T
            if not start and dots.shape[1] > k:
                far = np.minimum(far, 1 - np.partition(dots, -k, axis=1)[:, -k] + slack)
            r, c = np.nonzero(dots >= (1 - far - slack).astype(np.float32)[:, None] - 1e-7)
            if not len(r):
                continue
            d = np.concatenate([1 - np.einsum("ij,ij->i", q[r[p]], vectors[start + c[p]]) for p in _slices(len(r), 4 * q.shape[1])])
            row, at, distance = np.append(row, r), np.append(at, start + c), np.append(distance, np.round(d, 12))  # equal vectors tie, wherever they stand
            order = np.lexsort((at, distance, row))
            row, at, distance = row[order], at[order], distance[order]
            firsts = np.searchsorted(row, np.arange(len(q)))
            rank = np.arange(len(row)) - firsts[row]
            last = np.flatnonzero(rank == k - 1)
            far[row[last]] = np.minimum(far[row[last]], distance[last])
            some = (rank < k) & (distance <= reach[low + row])
            row, at, distance = row[some], at[some], distance[some]
        out.append((row + low, kept[at], distance))
    return tuple(np.concatenate(x) for x in zip(*out))


def scored(pieces: DataFrame, asked: DataFrame, query: str, item: str, k: int, blocks: int, limit: float | None = None) -> DataFrame:
    """(query, item, distance): the k nearest of each piece that a query is sent to.

    pieces: (piece, item, v), asked: (piece, query, q, reach); piece by piece they meet in `blocks` groups of the queries.
    """
    kinds = asked.schema[query].dataType.simpleString(), pieces.schema[item].dataType.simpleString()

    def score(held: pa.Table, asking: pa.Table) -> pa.Table:
        ids, names = held[item].combine_chunks(), asking[query].combine_chunks()
        if not len(ids) or not len(names):
            return pa.table({query: names.slice(0, 0), item: ids.slice(0, 0), "distance": pa.array([], pa.float64())})
        place = pc.array_sort_indices(ids, null_placement="at_start").to_numpy()
        reach = np.nan_to_num(asking["reach"].to_numpy().astype(np.float64), nan=3.0)
        row, at, distance = _best(_matrix(held["v"])[place], _matrix(asking["q"]), reach, k)
        if limit is not None:
            near = distance < limit
            row, at, distance = row[near], at[near], distance[near]
        return pa.table({query: names.take(pa.array(row)), item: ids.take(pa.array(place[at])), "distance": pa.array(distance)})

    asked = asked.withColumn("block", F.pmod(F.xxhash64(query), F.lit(blocks)).cast("int"))
    pieces = pieces.select("piece", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), item, "v")
    return pieces.groupBy("piece", "block").cogroup(asked.groupBy("piece", "block")).applyInArrow(score, f"`{query}` {kinds[0]}, `{item}` {kinds[1]}, distance double")


def ranked(found: DataFrame, query: str, item: str, k: int) -> DataFrame:
    w = Window.partitionBy(query).orderBy("distance", item)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def with_vectors(rows: DataFrame, item: str, vector: str, name: str) -> DataFrame:
    """(item, name) of the rows that have a vector, dealt out to all cores."""
    return spread(rows.where(F.col(vector).isNotNull() & (F.size(vector) > 0)).select(item, F.col(vector).cast("array<double>").alias(name)))


def asked_rows(queries: DataFrame, query: str, vector: str) -> DataFrame:
    """(query, q) of the queries with a vector, written once."""
    return written(with_vectors(queries, query, vector, "q"), "vectors-queries")


def in_blocks(n: int) -> int:
    """How many groups of bounded size n rows make."""
    return max(1, -(-n // _PIECE))


@dataclass
class _Lists:
    """What every task needs to choose pieces: a row a list, at most `max_lists` of them."""

    centroids: np.ndarray
    sizes: np.ndarray
    radius: np.ndarray  # the widest angle between the centroid and a vector of its list
    first: np.ndarray | None = None  # the list's first piece
    parts: np.ndarray | None = None  # and in how many pieces it is

    def laid_out(self) -> None:
        """Lists in order, as many to a piece as it can hold; a longer list has pieces of its own."""
        first, used, piece = np.zeros(len(self.sizes), np.int64), 0, 0
        self.parts = np.maximum(1, -(-self.sizes.astype(np.int64) // _PIECE))
        for i, n in enumerate(self.sizes.tolist()):
            if used and used + n > _PIECE:
                used, piece = 0, piece + 1
            first[i] = piece
            used += n
            if self.parts[i] > 1:
                used, piece = 0, piece + int(self.parts[i])
        self.first = first

    def order(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each query the lists from near to far, their angles, and the share of all vectors in nearer lists."""
        angles = np.arccos(np.clip(queries @ self.centroids.T, -1, 1))
        lists = np.argsort(angles, axis=1, kind="stable")
        held = self.sizes[lists]
        before = (np.cumsum(held, axis=1) - held) / max(1, self.sizes.sum())
        return lists, np.take_along_axis(angles, lists, 1), before

    def pieces(self, row: np.ndarray, lists: np.ndarray) -> np.ndarray:
        """row * number of pieces + piece, once for each row and piece that one of its lists is in."""
        n, parts = self.count, self.parts[lists]
        within = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        return np.unique(np.repeat(row * n + self.first[lists], parts) + within)

    @property
    def count(self) -> int:
        return int((self.first + self.parts).max())


class VectorIndex:
    """(item, list, piece, v) in the shared folder, with its lists and the share of vectors that a query probes."""

    def __init__(self, postings: DataFrame, lists: _Lists, share: float, item: str, least: float = SHARE):
        self.postings, self.lists, self.share, self.item, self.least = postings, lists, share, item, least

    @classmethod
    def build(cls, vectors: DataFrame, *, item: str = "id", vector: str = "embedding", leaf: int = LEAF, max_lists: int = 16_384, fit_rows: int = 100_000, share: float = SHARE, target: float = 0.97, k: int = 10, sample: int = 200, seed: int = 7) -> VectorIndex:
        """Fit, assign, write and measure. `fit_rows` vectors at most are fitted on, `sample` at most are measured with."""
        rows = written(with_vectors(vectors, item, vector, "v"), "vectors-rows")
        n = rows.count()
        if not n:
            empty = rows.select(item, F.lit(0).alias("list"), F.lit(0).alias("piece"), "v").limit(0)
            return cls(empty, _Lists(np.zeros((1, 1)), np.zeros(1), np.zeros(1)), share, item, share)
        near = rows.sparkSession.sparkContext.broadcast(cls._centroids(rows, item, min(max_lists, max(1, -(-n // leaf))), max(1, -(-n // fit_rows)), seed))
        kind = rows.schema[item].dataType.simpleString()

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    found, angle = _nearest(_matrix(batch.column(1)), near.value)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found), pa.array(angle)], names=[item, "v", "list", "angle"])

        assigned = written(rows.mapInArrow(assign, f"`{item}` {kind}, v array<double>, list int, angle double"), "vectors-assigned")
        found = assigned.groupBy("list").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).toPandas()  # a row a list
        table = _Lists(near.value, np.zeros(len(near.value), np.int64), np.zeros(len(near.value)))
        table.sizes[found["list"]], table.radius[found["list"]] = found["n"], found["radius"]
        table.laid_out()
        places = rows.sparkSession.createDataFrame(pa.table({"list": np.arange(len(table.sizes), dtype=np.int32), "first": table.first, "parts": table.parts}))
        placed = assigned.join(F.broadcast(places), "list").select(item, "list", (F.col("first") + F.pmod(F.xxhash64(item), F.col("parts"))).cast("int").alias("piece"), "v")
        out = cls(placed, table, share, item, share)
        out.share = max(share, out._needed(target, k, sample, n))
        return out

    @staticmethod
    def _centroids(rows: DataFrame, item: str, lists: int, every: int, seed: int) -> np.ndarray:
        """At most `lists` centroids, those of one coarse group after those of another."""
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        some = rows.where(F.pmod(F.xxhash64(item, F.lit(seed)), F.lit(every)) == 0).where(F.exists("v", lambda x: x != 0)).select("v", array_to_vector("v").alias("features"))
        held = some.count()
        if lists == 1 or held < 2:
            return np.eye(1, rows.select(F.size("v").alias("n")).first().n)
        groups = max(2, int(np.ceil(np.sqrt(min(lists, held)))))
        coarse = KMeans(k=groups, distanceMeasure="cosine", seed=seed, maxIter=10, predictionCol="place").fit(some)

        def fit(group: pa.Table) -> pa.Table:
            unit = _matrix(group["v"])
            centroids = _fitted(unit, max(1, round(len(unit) * min(lists, held) / held)), seed)
            return pa.table({"place": pa.array(np.full(len(centroids), group["place"][0].as_py(), np.int32)), "v": pa.array(list(centroids), pa.list_(pa.float64()))})

        found = coarse.transform(some).select("place", "v").groupBy("place").applyInArrow(fit, "place int, v array<double>").orderBy("place", "v").toArrow()  # a row a list
        return _matrix(found["v"])

    def _needed(self, target: float, k: int, sample: int, n: int) -> float:
        """The least share of vectors to probe that holds `target` of the true neighbours of sampled vectors."""
        asked = self.postings.where(F.pmod(F.xxhash64(self.item, F.lit(11)), F.lit(max(1, -(-n // sample)))) == 0).select(F.col(self.item).alias("query"), F.col("v").alias("embedding"))
        true = self.search(asked, k, query="query", share=1.0)
        where = true.join(self.postings.select(self.item, "list"), self.item).join(asked, "query").select("list", F.col("embedding").alias("v")).toArrow()  # sample * k rows
        needed = []
        for part in _slices(where.num_rows, 4 * len(self.lists.sizes)):
            some = where.slice(part.start, part.stop - part.start)
            lists, _, before = self.lists.order(_matrix(some["v"]))
            place = (lists == some["list"].to_numpy()[:, None]).argmax(1)
            needed.append(before[np.arange(len(place)), place])
        return float(np.quantile(np.concatenate(needed), target, method="higher")) + 1e-9 if needed else 0.0

    def _probes(self, queries: DataFrame, query: str, share: float, rest: bool = False) -> DataFrame:
        """(piece, query, q, reach): the pieces of the nearest lists of each query (query, q, reach), until they hold its share of the vectors.

        With `rest`, all others with a list that may hold a vector nearer than `reach`, the k-th distance so far (null: none yet).
        """
        if not self.lists.sizes.sum():
            return queries.select(F.lit(0).alias("piece"), query, "q", "reach").limit(0)
        shared = queries.sparkSession.sparkContext.broadcast(self.lists)
        kind = queries.schema[query].dataType.simpleString()

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = shared.value
            for batch in batches:
                for part in _slices(batch.num_rows, 4 * len(table.sizes)):
                    some = batch.slice(part.start, part.stop - part.start)
                    unit = _matrix(some.column(1))
                    lists, angles, before = table.order(unit)
                    probed = (before < share) & (table.sizes[lists] > 0)
                    row, at = np.nonzero(probed)
                    chosen = table.pieces(row, lists[row, at])
                    if rest:
                        reach = np.clip(np.nan_to_num(some.column(2).to_numpy(zero_copy_only=False).astype(np.float64), nan=2.0), 0, 2)
                        wide = np.where(np.abs(unit).sum(1) > 0, np.arccos(np.clip(1 - reach, -1, 1)), np.pi)
                        row, at = np.nonzero(~probed & (table.sizes[lists] > 0) & (angles - table.radius[lists] <= wide[:, None] + 1e-5))
                        chosen = np.setdiff1d(table.pieces(row, lists[row, at]), chosen, assume_unique=True)
                    row, piece = np.divmod(chosen, table.count)
                    for p in _slices(len(row), 4 * unit.shape[1]):
                        yield pa.RecordBatch.from_arrays([pa.array(piece[p].astype(np.int32)), *(c.take(pa.array(row[p])) for c in some.columns)], names=["piece", query, "q", "reach"])

        return queries.select(query, "q", "reach").mapInArrow(choose, f"piece int, `{query}` {kind}, q array<double>, reach double")

    def search(self, queries: DataFrame, k: int, *, query: str = "query_id", vector: str = "embedding", limit: float | None = None, share: float | None = None, exact: bool = False) -> DataFrame:
        """(query, item, distance, rank): the k nearest found in the pieces of the index's share; with exact=True the k nearest of all."""
        share = (self.least if exact else self.share) if share is None else share
        asked = asked_rows(queries, query, vector)
        blocks = in_blocks(asked.count())
        first = asked.withColumn("reach", F.lit(limit).cast("double"))
        found = ranked(scored(self.postings, self._probes(first, query, share), query, self.item, k, blocks, limit), query, self.item, k)
        if exact and share < 1 and len(self.lists.sizes) > 1:
            found = written(found, "vectors-found")
            kth = found.where(F.col("rank") == k).select(query, F.col("distance").alias("reach"))
            reach = F.col("reach") if limit is None else F.coalesce("reach", F.lit(float(limit)))
            more = self._probes(asked.join(kth, query, "left").withColumn("reach", reach), query, share, rest=True)
            found = ranked(found.drop("rank").unionByName(scored(self.postings, more, query, self.item, k, blocks, limit)), query, self.item, k)
        return found
