"""Exact Ward linkage beyond one task, by rounds of mutual nearest neighbours.

A cluster is its size and mean; the Ward distance of two follows from these.
Each round finds the nearest cluster of every cluster whose last one is gone, in
tiles of two blocks, and merges all pairs that are each other's nearest.  Merging
two never brings a third nearer than both were, so these are merges of the one
dendrogram, whatever the order, and a neighbour that still stands stays nearest.
When ``most`` clusters are left, one task makes their merges from a matrix.  No
task holds more than a tile or that matrix.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.operators.communities import components
from wordloom.sources.catalog import materialise

BLOCK = 2048
#: Clusters whose matrix of distances one task holds (n x n doubles).
MOST = 4096
#: Blocks of clusters, at most; beyond, blocks grow up to ``WIDE`` clusters, so that what tiles shuffle grows as the input does.
TILES, WIDE = 16, 16_384
#: Rows of a tile whose distances are held at a time.
ROWS = 256


def ward_matrix(a: np.ndarray, size_a: np.ndarray, b: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Ward distances (rises of the sum of squares, times two) between the clusters of two lists."""
    far = np.maximum((a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None, :] - 2 * a @ b.T, 0)
    return far * (2 * size_a[:, None] * size_b[None, :] / (size_a[:, None] + size_b[None, :]))


def merges_of(points: np.ndarray, size: np.ndarray) -> list[tuple[float, int, int]]:
    """(height, a, b), a < b places of the merged clusters' first members, by nearest-neighbour chains in one matrix."""
    n, size = len(points), size.astype(float).copy()
    far = ward_matrix(points, size, points, size)
    np.fill_diagonal(far, np.inf)
    alive, chain, merges = np.ones(n, bool), [], []
    for _ in range(n - 1):
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        while True:
            x = chain[-1]
            row = np.where(alive, far[x], np.inf)
            y = int(row.argmin())
            if len(chain) > 1 and row[chain[-2]] <= row[y]:
                y = chain[-2]
                break
            chain.append(y)
        chain = chain[:-2]
        a, b = min(x, y), max(x, y)
        height = float(far[a, b])
        merges.append((height, a, b))
        new = ((size[a] + size) * far[a] + (size[b] + size) * far[b] - size * height) / (size[a] + size[b] + size)
        far[a], far[:, a], far[a, a] = new, new, np.inf
        alive[b] = False
        size[a] += size[b]
    return merges


def blocks_of(n: int, block: int) -> int:
    """Blocks of ``n`` clusters: of ``block`` each, or of more where these would be many."""
    return max(min(-(-n // block), max(TILES, -(-n // WIDE))), 1)


def _nearest(stale: DataFrame, clusters: DataFrame, block: int) -> DataFrame:
    """id, other, height: the nearest of ``clusters`` (id, size, mean) for each of ``stale``; ties to the least id."""
    tiles = blocks_of(clusters.count(), block)
    of = lambda c: F.pmod(F.xxhash64(c), F.lit(tiles))
    every = F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))
    asked = stale.select(of("id").alias("qa"), every.alias("qb"), F.lit(0).alias("side"), "id", "size", "mean")
    there = clusters.select(every.alias("qa"), of("id").alias("qb"), F.lit(1).alias("side"), "id", "size", "mean")

    def tile(table: pa.Table) -> pa.Table:
        side, ids = table.column("side").to_numpy(), table.column("id").to_numpy()
        if not (side == 0).any() or not (side == 1).any():
            return pa.table({"id": pa.array([], pa.int64()), "other": pa.array([], pa.int64()), "height": pa.array([], pa.float64())})
        order = np.lexsort((ids, side))
        side, ids = side[order], ids[order]
        means = table.column("mean").combine_chunks().flatten().to_numpy().reshape(len(side), -1)[order]
        size, q, c = table.column("size").to_numpy()[order].astype(float), side == 0, side == 1
        best, found = np.zeros(int(q.sum()), np.int64), np.zeros(int(q.sum()))
        for first in range(0, len(best), ROWS):
            rows = np.flatnonzero(q)[first : first + ROWS]
            far = ward_matrix(means[rows], size[rows], means[c], size[c])
            far[ids[rows][:, None] == ids[c][None, :]] = np.inf
            best[first : first + ROWS] = far.argmin(axis=1)
            found[first : first + ROWS] = far.min(axis=1)
        real = np.isfinite(found)
        return pa.table({"id": ids[q][real], "other": ids[c][best][real], "height": found[real]})

    near = asked.unionByName(there).groupBy("qa", "qb").applyInArrow(tile, "id long, other long, height double")
    return near.groupBy("id").agg(F.min(F.struct("height", "other")).alias("m")).select("id", "m.other", "m.height")


def ward_merges(points: DataFrame, block: int = BLOCK, most: int = MOST) -> DataFrame:
    """a, b (least members of the merged clusters), height of all merges of ``points`` (id, emb)."""
    now = materialise(points.select("id", F.lit(1).cast("long").alias("size"), F.col("emb").cast("array<double>").alias("mean")), "ward")
    made, near = None, None
    n = now.count()
    while n > max(most, 1):
        stale = now if near is None else now.join(near.select("id"), "id", "left_anti")
        fresh = _nearest(stale, now, block)
        near = materialise(fresh if near is None else near.unionByName(fresh), "ward-near")
        back = near.select(F.col("id").alias("other"), F.col("other").alias("id"), F.col("height").alias("seen"))
        mutual = near.join(back, ["id", "other"]).where("id < other").select(F.col("id").alias("a"), F.col("other").alias("b"), F.least("height", "seen").alias("height"))
        merges = materialise(mutual, "ward-merges")
        if merges.isEmpty():  # rounding has turned a tie one way here and the other way there
            least = near.orderBy("height", "id").limit(1)
            merges = materialise(least.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"), "height"), "ward-merges")
        made = merges if made is None else made.unionByName(merges)
        pairs = merges.select(F.col("a").alias("id"), "a").unionByName(merges.select(F.col("b").alias("id"), "a"))
        moved = now.join(pairs, "id").groupBy("a").agg(F.sum("size").alias("size"), F.min_by(F.struct("size", "mean"), "id").alias("x"), F.max_by(F.struct("size", "mean"), "id").alias("y"))
        mean = F.zip_with("x.mean", "y.mean", lambda p, q: (p * F.col("x.size") + q * F.col("y.size")) / (F.col("x.size") + F.col("y.size")))
        gone = pairs.select("id")
        now = materialise(now.join(gone, "id", "left_anti").unionByName(moved.select(F.col("a").alias("id"), "size", mean.alias("mean"))), "ward")
        near = materialise(near.join(gone, "id", "left_anti").join(gone.withColumnRenamed("id", "other"), "other", "left_anti").select("id", "other", "height"), "ward-near")
        n = now.count()

    def finish(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        ids, means = table.column("id").to_numpy(), np.array(table.column("mean").to_pylist(), float)
        merges = merges_of(means, table.column("size").to_numpy())
        return pa.table({"a": pa.array([ids[a] for _, a, _ in merges], pa.int64()), "b": pa.array([ids[b] for _, _, b in merges], pa.int64()), "height": pa.array([h for h, _, _ in merges], pa.float64())})

    rest = now.groupBy(F.lit(0).alias("one")).applyInArrow(finish, "a long, b long, height double")
    return materialise(rest if made is None else made.unionByName(rest), "ward-merges")


def ward_cut(points: DataFrame, k: int, block: int = BLOCK, most: int = MOST) -> DataFrame:
    """id, label (a cluster's least id): the ``k`` clusters that are left when the lowest merges of ``points`` (id, emb) are made."""
    merges = ward_merges(points, block, most)
    keep = max(merges.count() + 1 - max(k, 1), 0)
    # heights rise along the dendrogram, so the lowest merges form whole clusters
    lowest = merges.orderBy("height", "a", "b").limit(keep)
    found = components(points.select(F.col("id").alias("node_id")), lowest.select(F.col("a").alias("i"), F.col("b").alias("j")))
    return found.select(F.col("node_id").alias("id"), F.col("component").alias("label"))
