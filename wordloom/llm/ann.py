"""Approximate nearest neighbours by largest inner product: a forest of random-projection trees.

Vectors get one more coordinate, sqrt(M^2 - |v|^2) with M the largest norm, so
that the largest inner product is the smallest angle; a query gets 0 there and
the length M, which changes no order.  The forest is fitted on a bounded sample (``SAMPLE`` vectors, those whose id hashes lowest): a node
splits along the difference of two random points at the median.  Then every
vector is put into one leaf of each tree; leaves are cut into parts of about
``PART_ROWS`` vectors, whose number follows from the leaf's true size.

A query searches all trees through one priority queue, ordered by the margin to
the nearest split crossed so far, until the leaves taken hold ``candidates``
rows.  It is joined to the parts of these leaves; exact inner products rerank them
in double precision.  The sample itself is searched first, whole: its best are
found candidates like all others, so every query has its ``k`` rows, and parts pass
on only what is at least as near as they are.

Unless given, the number of candidates and of trees is measured: for some of the
queries, each tree count tells how many rows of the sample a search must read until
a share ``recall`` of the sample's nearest has come up, and the cheapest is taken.
One tree read whole is an exact search, so no query ever reads more rows than
that: clustered vectors get many trees and few leaves, vectors without structure
few trees and most of the leaves.

Equal vectors are one entry that carries the ``k + 1`` smallest of their ids:
no answer can need more of them, so large groups of copies stay exact and small.

Defined results: vectors that are null, zero, hold null or non-finite
components, or do not have the most frequent length (of several, the least)
take no part; repeated ids count once, with the least of their vectors; ties go
to the smaller id; a query without candidates has no rows.
"""

from __future__ import annotations

import copy
import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordloom.llm._shared import spool, tasks_for

TREES, LEAF_ROWS, SAMPLE, RECALL = 10, 256, 16384, 0.97
#: Queries that a calibration searches for, at most.
CALIBRATION = 200
PART_ROWS, QUERY_BLOCK = 4096, 512
#: Pairs (query, neighbour) that a task holds before it passes its best ones on.
HELD_QUERIES = 50_000


class Forest:
    """Complete binary trees of one depth; node i has the children 2i+1 and 2i+2."""

    def __init__(self, sample: np.ndarray, trees: int, depth: int, seed: int = 11):
        inner, self.depth, self.trees = (1 << depth) - 1, depth, trees
        self.normals = np.zeros((trees, inner, sample.shape[1]))
        self.limits = np.zeros((trees, inner))
        rng = np.random.default_rng(seed)
        for t in range(trees):
            members = [np.arange(len(sample))]
            for node in range(inner):
                own = members[node]
                if len(own) >= 2:
                    a, b = sample[rng.choice(own, 2, replace=False)]
                    normal = a - b
                    length = np.linalg.norm(normal)
                    self.normals[t, node] = normal / length if length else 0
                height = sample[own] @ self.normals[t, node]
                self.limits[t, node] = np.median(height) if len(own) else 0
                right = height > self.limits[t, node]
                members += [own[~right], own[right]]

    def leaves(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point in each tree, as trees x points."""
        out = np.zeros((self.trees, len(points)), np.int64)
        for t in range(self.trees):
            node = np.zeros(len(points), np.int64)
            for _ in range(self.depth):
                height = np.einsum("ij,ij->i", points, self.normals[t, node])
                node = 2 * node + 1 + (height > self.limits[t, node])
            out[t] = node - ((1 << self.depth) - 1)
        return out

    def search(self, heights: np.ndarray, sizes: np.ndarray, wanted: float) -> list[tuple[int, int]]:
        """(tree, leaf) pairs for one query, nearest first, until they hold ``wanted`` rows.

        ``heights``: the query's signed distance to each split.
        """
        first_leaf, queue, taken, rows = (1 << self.depth) - 1, [(0.0, t, 0) for t in range(self.trees)], [], 0
        heapq.heapify(queue)
        while queue and rows < wanted:
            margin, t, node = heapq.heappop(queue)
            while node < first_leaf:
                height = heights[t, node]
                near = 2 * node + 1 + (height > 0)
                heapq.heappush(queue, (max(margin, abs(height)), t, 4 * node + 3 - near))
                node = near
            leaf = node - first_leaf
            if sizes[t, leaf]:
                taken.append((t, leaf))
                rows += int(sizes[t, leaf])
        return taken

    def first(self, trees: int) -> Forest:
        """The forest of the first ``trees`` trees."""
        out = copy.copy(self)
        out.trees, out.normals, out.limits = trees, self.normals[:trees], self.limits[:trees]
        return out

    def heights(self, points: np.ndarray) -> np.ndarray:
        """Signed distances of points to all splits, points x trees x splits."""
        return np.einsum("qd,tnd->qtn", points, self.normals) - self.limits

    def cost(self, leaves: np.ndarray, asked: np.ndarray, near: np.ndarray) -> np.ndarray:
        """Rows that a search for each query point reads until each of its neighbours ``near`` comes up.

        ``leaves``: those of the rows, as :meth:`leaves` gives them.
        """
        sizes = np.stack([np.bincount(x, minlength=1 << self.depth) for x in leaves[: self.trees]])
        out = np.zeros(near.shape)
        for q in range(len(asked)):
            order = self.search(self.heights(asked[q : q + 1])[0], sizes, np.inf)
            place = np.full(sizes.shape, np.inf)
            read = np.cumsum([sizes[t, x] for t, x in order])
            place[tuple(np.array(order).T)] = read
            out[q] = place[np.arange(self.trees)[:, None], leaves[: self.trees][:, near[q]]].min(axis=0)
        return out


def calibrate(forest: Forest, sample: np.ndarray, asked: np.ndarray, own: np.ndarray, norm: float, k: int, total: int, recall: float) -> tuple[int, int]:
    """(trees, rows to read of ``total``) that find a share ``recall`` of the ``k`` nearest of the queries ``asked``.

    ``sample`` are the vectors that the forest was fitted on; ``own`` is a query's
    place among them, or -1.  The sample stands for the table, so of the k nearest
    as many are looked for as the sample holds.
    """
    if len(sample) < 3 or not len(asked):
        return 1, total
    near_count = int(np.clip(np.ceil(k * len(sample) / total), 1, len(sample) - 1))
    scores = asked @ sample.T
    scores[np.flatnonzero(own >= 0), own[own >= 0]] = -np.inf
    near = np.argpartition(-scores, near_count - 1, axis=1)[:, :near_count]
    leaves = forest.leaves(_augment(sample, norm))
    points = _query_points(asked, norm)
    best = (1, float(len(sample)))
    for trees in sorted({1, 2, max(forest.trees // 2, 1), forest.trees}):
        if trees <= forest.trees:
            rows = float(np.quantile(forest.first(trees).cost(leaves, points, near), recall, method="higher"))
            if rows < best[1]:
                best = (trees, rows)
    return best[0], min(int(np.ceil(best[1] / len(sample) * total)), total)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.stack([np.frombuffer(x, np.float64) for x in column.to_pylist()]) if len(column) else np.zeros((0, 0))


def _augment(points: np.ndarray, norm: float) -> np.ndarray:
    return np.column_stack([points, np.sqrt(np.maximum(norm**2 - (points**2).sum(axis=1), 0))])


def _query_points(points: np.ndarray, norm: float) -> np.ndarray:
    """Queries on the sphere of the augmented vectors: of length ``norm``, with 0 as the last coordinate."""
    return np.column_stack([points * (norm / np.linalg.norm(points, axis=1))[:, None], np.zeros(len(points))])


def _to_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        vectors = [np.array(v, np.float64).tobytes() for v in b.column("v").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(vectors, pa.binary()), b.column("ids")], names=["id", "v", "ids"])


def _route(forest: Broadcast, norm: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            leaves = forest.value.leaves(_augment(_matrix(b.column("v")), norm))
            for t in range(len(leaves)):
                leaf = pa.array((t << 32) + leaves[t])
                yield pa.RecordBatch.from_arrays([leaf, b.column("id"), b.column("v")], names=["leaf", "id", "v"])

    return run


def _start(ids: Broadcast, pilot: Broadcast, most: int) -> Callable:
    """Each query with its ``most`` best of the sample and the least of their scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            plain = _matrix(b.column("v"))
            for first in range(0, b.num_rows, 256):
                scores = plain[first : first + 256] @ pilot.value.T
                n = min(most, scores.shape[1])
                best = np.argpartition(-scores, n - 1, axis=1)[:, :n]
                found = np.take_along_axis(scores, best, axis=1)
                floor = found.min(axis=1) if n == most else np.full(len(scores), -np.inf)
                hits = [pa.array(list(x), kind) for x, kind in ((ids.value[best], pa.list_(pa.int64())), (found, pa.list_(pa.float64())))]
                part = b.slice(first, len(scores))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("v"), pa.array(floor), *hits], names=["id", "v", "floor", "hits", "scores"])

    return run


def _visit(forest: Broadcast, norm: float, sizes: np.ndarray, parts: np.ndarray, wanted: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = forest.value
        for b in batches:
            if not b.num_rows:
                continue
            points = _query_points(_matrix(b.column("v")), norm)
            for first in range(0, len(points), 256):
                heights = f.heights(points[first : first + 256])
                leaf, part, row = [], [], []
                for k in range(len(heights)):
                    for t, x in f.search(heights[k], sizes, wanted):
                        n = int(parts[t, x])
                        leaf += [(t << 32) + x] * n
                        part += range(n)
                        row += [first + k] * n
                take = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int64()), pa.array(part, pa.int32()), *(b.column(c).take(take) for c in ("id", "v", "floor"))], names=["leaf", "part", "id", "v", "floor"])

    return run


def _rerank(k: int) -> Callable:
    """Rows sorted by (leaf, part, kind): a part's vectors (kind 0), then the queries that visit it."""

    def best(ids: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((ids, -scores))
        ids, scores = ids[order], scores[order]
        _, first = np.unique(ids, return_index=True)
        first = np.sort(first)[:k]
        return ids[first], scores[first]

    def flush(held: dict) -> pa.RecordBatch:
        query = np.repeat(np.array(list(held), np.int64), [len(x[0]) for x in held.values()])
        ids = np.concatenate([x[0] for x in held.values()]) if held else np.zeros(0, np.int64)
        scores = np.concatenate([x[1] for x in held.values()]) if held else np.zeros(0)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(query), pa.array(ids), pa.array(scores)], names=["query_id", "id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        at, ids, vectors = None, [], []
        for b in batches:
            keys = list(zip(b.column("leaf").to_pylist(), b.column("part").to_pylist(), b.column("kind").to_pylist(), strict=True))
            points, row_ids, floor = _matrix(b.column("v")), b.column("id").to_numpy(), b.column("floor").to_numpy()
            row = 0
            while row < len(keys):
                end = row + 1
                while end < len(keys) and keys[end] == keys[row] and end - row < QUERY_BLOCK:
                    end += 1
                if keys[row][:2] != at:
                    at, ids, vectors = keys[row][:2], [], []
                if keys[row][2] == 0:
                    ids.append(row_ids[row:end])
                    vectors.append(points[row:end])
                elif ids:
                    all_ids, matrix = np.concatenate(ids), np.concatenate(vectors)
                    ids, vectors = [all_ids], [matrix]
                    scores = points[row:end] @ matrix.T
                    for q, s, least in zip(row_ids[row:end].tolist(), scores, floor[row:end].tolist(), strict=True):
                        keep = np.flatnonzero(s >= least - 1e-9 * max(abs(least), 1.0) if np.isfinite(least) else s == s)
                        if len(keep) > 2 * k:  # all that tie with the k-th stay
                            keep = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k])
                        if not len(keep):
                            continue
                        new, old = (all_ids[keep], s[keep]), held.get(q)
                        held[q] = best(*new) if old is None else best(np.concatenate([old[0], new[0]]), np.concatenate([old[1], new[1]]))
                row = end
            if len(held) > HELD_QUERIES:
                yield flush(held)
        yield flush(held)

    return run


def vector_length(table: DataFrame, vector_column: str) -> int:
    """The most frequent length of the usable vectors (of several, the least); 0 if there are none."""
    top = _usable(table.select(F.col(vector_column).cast("array<double>").alias("v"))).groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return top["d"] if top else 0


def _usable(rows: DataFrame) -> DataFrame:
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))


def valid_vectors(table: DataFrame, id_column: str, vector_column: str, length: int) -> DataFrame:
    """id, v array<double> of the vectors that take part, one for each id."""
    rows = table.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v")).where("id is not null")
    return _usable(rows).where(F.size("v") == length).groupBy("id").agg(F.min("v").alias("v"))


def search(table: DataFrame, queries: DataFrame, k: int = 20, id_column: str = "vec_id", vector_column: str = "embedding", trees: int = TREES, candidates: int | None = None, recall: float = RECALL, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found in ``table`` for each row of ``queries``,
    which has the same columns and may hold vectors that ``table`` lacks.

    ``candidates`` are the rows that a query reads; without it, those that
    :func:`calibrate` finds for ``recall``.  A query's own id is no candidate.  The sample, the forest (trees x sample /
    8 splits at most) and the leaf sizes are bounded by the parameters, whatever
    the table's size; nothing else reaches the driver or is broadcast.
    """
    spark = table.sparkSession
    length = vector_length(table.where(F.col(id_column).isNotNull()), vector_column)
    points = spool(valid_vectors(table, id_column, vector_column, length), "ann")
    ranked = points.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("n") <= k + 1)
    entries = ranked.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(F.element_at("ids", 1).alias("id"), "v", "ids")
    entries = spool(entries.mapInArrow(_to_bytes, "id long, v binary, ids array<long>"), "ann")
    asked = valid_vectors(queries, id_column, vector_column, length).withColumn("ids", F.array("id"))
    asked = asked.mapInArrow(_to_bytes, "id long, v binary, ids array<long>").select("id", "v")
    total = entries.count()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not total:
        return empty
    drawn = entries.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(sample).toPandas()
    vectors = np.stack([np.frombuffer(x, np.float64) for x in drawn["v"]])
    norm = float(np.sqrt(points.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()[0]))
    depth = max(0, int(np.ceil(np.log2(max(1, min(total / LEAF_ROWS, len(vectors) / 8))))))
    fitted = Forest(_augment(vectors, norm), trees, depth)
    if candidates is None:
        some = asked.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(CALIBRATION).toPandas()
        place = {int(i): n for n, i in enumerate(drawn["id"])}
        own = np.array([place.get(int(i), -1) for i in some["id"]], np.int64)
        trees, candidates = calibrate(fitted, vectors, _matrix(pa.array(some["v"], pa.binary())), own, norm, k, total, recall)
    elif candidates >= total:  # one tree read whole is an exact search
        trees, candidates = 1, total
    forest = spark.sparkContext.broadcast(fitted.first(trees))
    pilot, pilot_ids = spark.sparkContext.broadcast(vectors), spark.sparkContext.broadcast(drawn["id"].to_numpy(np.int64))
    tasks = tasks_for(table)
    started = asked.repartition(tasks, "id").mapInArrow(_start(pilot_ids, pilot, k + 1), "id long, v binary, floor double, hits array<long>, scores array<double>")
    started = spool(started, "ann")
    routed = spool(entries.select("id", "v").mapInArrow(_route(forest, norm), "leaf long, id long, v binary"), "ann")
    sizes = np.zeros((trees, 1 << depth), np.int64)
    for r in routed.groupBy("leaf").count().collect():  # trees x leaves rows
        sizes[r["leaf"] >> 32, r["leaf"] & 0xFFFFFFFF] = r["count"]
    parts = np.maximum(-(-sizes // PART_ROWS), 1)
    counts = spark.createDataFrame([((t << 32) + x, int(parts[t, x])) for t in range(trees) for x in range(1 << depth)], "leaf long, parts int")
    routed = routed.join(F.broadcast(counts), "leaf")  # trees x leaves rows
    stored = routed.select("leaf", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"), F.lit(0).alias("kind"), "id", "v", F.lit(0.0).alias("floor"))
    visits = started.select("id", "v", "floor").mapInArrow(_visit(forest, norm, sizes, parts, candidates), "leaf long, part int, id long, v binary, floor double")
    both = stored.unionByName(visits.select("leaf", "part", F.lit(1).alias("kind"), "id", "v", "floor"))
    scored = both.repartition(tasks, "leaf", "part").sortWithinPartitions("leaf", "part", "kind", "id").mapInArrow(_rerank(k + 1), "query_id long, id long, score double")
    pairs = started.select(F.col("id").alias("query_id"), F.inline(F.arrays_zip("hits", "scores")))
    scored = scored.unionByName(pairs.select("query_id", F.col("hits").alias("id"), F.col("scores").alias("score")))
    nearest = scored.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    nearest = nearest.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("n") <= k + 1)
    copies = nearest.join(entries.select("id", "ids"), "id").select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return copies.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
