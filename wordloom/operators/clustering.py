"""Centroid and tree clustering: k-means, Ward, BIRCH."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.operators import hierarchy
from wordloom.operators.cftree import BRANCHING, Tree
from wordloom.operators.hierarchy import merges_of
from wordloom.operators.lookup import node_ids
from wordloom.sources.catalog import materialise

KMEANS_ROUNDS, KMEANS_RUNS = 15, 3
#: Runs of 2-means that look for the halves of a cluster.
DRAWS = 8
#: Centres that k-means++ draws one by one, at most.
PLUS_PLUS = 512
BIRCH_THRESHOLD = 0.25
#: Sub-clusters that one task merges; the distance threshold grows until they fit.
BIRCH_LEAVES = 4096
#: Rows whose distances to all centres are held at a time.
ROWS = 256


def distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances by a matrix product; rounding may be off in the last places."""
    return (points**2).sum(axis=1)[:, None] + (centres**2).sum(axis=1)[None, :] - 2 * points @ centres.T


def candidates(far: np.ndarray, rank: int) -> list[np.ndarray]:
    """For each row the entries that may be among its ``rank`` least, whatever the rounding."""
    rank = min(rank, far.shape[1])
    limit = np.partition(far, rank - 1, axis=1)[:, rank - 1] if far.shape[1] else np.zeros(len(far))
    slack = 1e-9 * (1 + np.abs(far).max(axis=1, initial=0))
    return [np.flatnonzero(row <= most) for row, most in zip(far, limit + slack, strict=True)]


def _matrix(column: pa.ListArray) -> np.ndarray:
    """The vectors of a column as rows; without nulls they are read off as they lie in memory."""
    flat = column.flatten()
    if column.null_count or flat.null_count or not len(column):
        return np.array(column.to_pylist(), float).reshape(len(column), -1 if len(column) else 0)
    return flat.to_numpy().astype(float, copy=False).reshape(len(column), -1)


def assign(points: DataFrame, centres: list[list[float]]) -> DataFrame:
    """``points`` (emb) with label, the nearest centre (ties to the first), and its squared distance.

    The centres go to the workers as one matrix; products of blocks choose, exact differences decide.
    """
    book = np.array(centres, float)
    schema = T.StructType([*points.schema.fields, T.StructField("label", T.LongType()), T.StructField("d", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            label, d = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows)
            x = _matrix(b.column("emb"))
            for first in range(0, b.num_rows, ROWS):
                far = distances(x[first : first + ROWS], book)
                best = far.argmin(axis=1)
                label[first : first + ROWS] = best
                d[first : first + ROWS] = ((book[best] - x[first : first + ROWS]) ** 2).sum(axis=1)
                slack = 1e-9 * (1 + np.abs(far).max(axis=1, initial=0))
                for k in np.flatnonzero((far <= (far[np.arange(len(best)), best] + slack)[:, None]).sum(axis=1) > 1):
                    near = np.flatnonzero(far[k] <= far[k, best[k]] + slack[k])
                    exact = ((book[near] - x[first + k]) ** 2).sum(axis=1)
                    label[first + k], d[first + k] = near[exact.argmin()], exact.min()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(label), pa.array(d)], names=[*b.schema.names, "label", "d"])

    return points.mapInArrow(run, schema)


def lloyd(points: DataFrame, centres: list[list[float]], rounds: int = KMEANS_ROUNDS) -> tuple[DataFrame, list[list[float]], float]:
    """(labelled points, centres, inertia) after ``rounds`` rounds from given centres.

    Only the centres, a parameter's worth of rows, come back from each round; a
    centre without points stays where it is.  The points are written once, so that
    rounds do not make them again.
    """
    return _lloyd(materialise(points, "kmeans-points"), centres, rounds)


def _lloyd(points: DataFrame, centres: list[list[float]], rounds: int) -> tuple[DataFrame, list[list[float]], float]:
    centres = [list(map(float, c)) for c in centres]
    for _ in range(rounds):
        labelled = assign(points, centres)
        means = labelled.groupBy("label").agg(vector_to_array(Summarizer.mean(array_to_vector("emb"))).alias("m")).collect()
        moved = list(centres)
        for r in means:
            moved[r["label"]] = r["m"]
        if moved == centres:
            break
        centres = moved
    labelled = assign(points, centres)
    inertia = labelled.agg(F.sum("d")).first()[0] or 0.0
    return labelled, centres, inertia


def draw(seed: int, run: int | Column, step: int, name: str = "node") -> Column:
    """A number in (0, 1] for each row, run and step: 48 bits of an MD5 digest."""
    parts = [F.lit(str(seed)), (F.lit(run) if isinstance(run, int) else run).cast("string"), F.lit(str(step)), F.col(name)]
    return (F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 12), 16, 10).cast("double") + 1) / float(1 << 48)


def first_centres(points: DataFrame, k: int, seed: int = 0, runs: int = KMEANS_RUNS) -> list[list[list[float]]]:
    """Centres by k-means++ for each of ``runs`` runs: rows drawn one after another with a chance
    in proportion to the squared distance from the nearest centre so far.

    The row of the least -ln(u) / distance, u being its own keyed draw, is such a
    draw; so a step is one pass for all runs, in which partitions keep their least
    rows, and it is repeatable whatever the partitioning.  Rows at distance 0 are
    never drawn; where no others are left, a run has fewer centres.
    """
    chosen: list[list[list[float]]] = [[] for _ in range(runs)]
    every = F.array(*[F.lit(1.0)] * runs)
    for step in range(k):
        far = points.select("node", "emb", every.alias("far")) if step == 0 else _least_distances(points.select("node", "emb"), chosen)
        each = far.select("node", "emb", F.posexplode("far").alias("run", "far")).where("far > 0")
        wait = -F.log(draw(seed, F.col("run"), step)) / F.col("far")
        best = each.groupBy("run").agg(F.min_by("emb", F.struct(wait, "node")).alias("emb")).collect()  # a row for each run
        for r in best:
            chosen[r["run"]].append([float(x) for x in r["emb"]])
    return chosen


def _least_distances(points: DataFrame, books: list[list[list[float]]]) -> DataFrame:
    """``points`` with far array<double>: the squared distance from the nearest centre of each list."""
    tables = [np.array(book, float) for book in books]
    schema = T.StructType([*points.schema.fields, *T.StructType.fromDDL("far array<double>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("emb"))
            far = np.full((b.num_rows, len(tables)), np.inf)
            for k, table in enumerate(tables):
                for c in table:  # exact differences: a centre's own row must be at distance 0
                    far[:, k] = np.minimum(far[:, k], ((x - c) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(far), pa.list_(pa.float64()))], names=[*b.schema.names, "far"])

    return points.mapInArrow(run, schema)


def _swapped(points: DataFrame, run: tuple[DataFrame, list[list[float]], float], seed: int, rounds: int) -> tuple[DataFrame, list[list[float]], float]:
    """A run in which no swap of one centre, as far as :func:`_halves` finds them, lowers the inertia.

    A centre goes, and its rows to their second centres; it comes back as one half
    of another cluster.  Swaps that gain more by the halves than those rows cost are
    tried with Lloyd rounds, the best first, until one lowers the inertia.
    """
    step, lower = 0, True
    while lower:
        labelled, centres, inertia = run
        seconds = _second_distances(labelled, centres).groupBy("label").agg(F.sum("d").alias("own"), F.sum(F.col("second") - F.col("d")).alias("missed")).collect()  # a row for each centre
        missed = {r["label"]: r["missed"] for r in seconds}
        halves = _halves(labelled, {r["label"]: r["own"] for r in seconds}, centres, seed, step, rounds)
        swaps = [(gain - missed.get(gone, 0.0), gone, c) for c, (gain, _, _) in halves.items() for gone in range(len(centres)) if gone != c]
        step, lower = step + 1, False
        for value, gone, c in sorted(swaps, key=lambda s: (-s[0], s[1:])):
            if not value > 1e-9 * inertia:
                break
            moved = list(centres)
            moved[c], moved[gone] = (list(map(float, half)) for half in halves[c][1:])
            tried = _lloyd(points, moved, rounds)
            if lower := tried[2] < inertia * (1 - 1e-9):
                run = tried
                break
    return run


def _halves(labelled: DataFrame, own: dict[int, float], centres: list[list[float]], seed: int, step: int, rounds: int) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """For each cluster (of inertia ``own``) how much two centres lower its inertia, and these: the best of ``DRAWS`` runs of 2-means.

    Runs start at the cluster's centre and one of its rows, drawn as for k-means++;
    all of them go on in the same passes.
    """
    waits = [F.struct(-F.log(draw(seed, KMEANS_RUNS + r, step)) / F.col("d"), F.col("node")) for r in range(DRAWS)]
    drawn = labelled.where("d > 0").groupBy("label").agg(*[F.min_by("emb", wait).alias(f"r{r}") for r, wait in enumerate(waits)]).collect()  # a row for each centre
    books = {r["label"]: np.array([[centres[r["label"]], r[f"r{k}"]] for k in range(DRAWS)], float) for r in drawn}
    found: dict[int, np.ndarray] = {}
    for _ in range(rounds):
        rows = _half_sums(labelled, books).groupBy("label", "draw", "half").agg(F.sum("n").alias("n"), F.sum("near").alias("near"), vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("sums")).collect()  # a row for each half
        found, moved = {c: np.zeros(DRAWS) for c in books}, {c: book.copy() for c, book in books.items()}
        for r in rows:
            found[r["label"]][r["draw"]] += r["near"]
            if r["n"]:
                moved[r["label"]][r["draw"], r["half"]] = np.array(r["sums"]) / r["n"]
        best = {c: int(near.argmin()) for c, near in found.items()}
        out = {c: (own[c] - found[c][k], *books[c][k]) for c, k in best.items()}
        if all((moved[c] == books[c]).all() for c in books):
            break
        books = moved
    return out if found else {}


def _half_sums(labelled: DataFrame, books: dict[int, np.ndarray]) -> DataFrame:
    """label, draw, half, n, near, sums: rows of a batch that are nearer to one of the two centres of a draw, with their squared distances and their sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, label = _matrix(b.column("emb")), b.column("label").to_numpy()
            out: dict[str, list] = {c: [] for c in ("label", "draw", "half", "n", "near", "sums")}
            for c in np.unique(label).tolist():
                if c not in books:
                    continue
                rows = x[label == c]
                for k, pair in enumerate(books[c]):
                    far = np.stack([((rows - centre) ** 2).sum(axis=1) for centre in pair])
                    side = far.argmin(axis=0)
                    for half in (0, 1):
                        at = side == half
                        for name, value in zip(out, (c, k, half, int(at.sum()), float(far[half, at].sum()), rows[at].sum(axis=0)), strict=True):
                            out[name].append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.list_(pa.float64())), strict=True)], names=list(out))

    return labelled.select("emb", "label").mapInArrow(run, "label long, draw int, half int, n long, near double, sums array<double>")


def _second_distances(labelled: DataFrame, centres: list[list[float]]) -> DataFrame:
    """label, d, second: the squared distance from the nearest centre but one's own."""
    book = np.array(centres, float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, label = _matrix(b.column("emb")), b.column("label").to_numpy()
            second = np.zeros(b.num_rows)
            for first in range(0, b.num_rows, ROWS):
                far = distances(x[first : first + ROWS], book)
                far[np.arange(len(far)), label[first : first + ROWS]] = np.inf
                second[first : first + ROWS] = far.min(axis=1)
            yield pa.RecordBatch.from_arrays([b.column("label"), b.column("d"), pa.array(second)], names=["label", "d", "second"])

    return labelled.select("emb", "label", "d").mapInArrow(run, "label long, d double, second double")


def kmeans(points: DataFrame, k: int, centres: list[list[float]] | None = None, seed: int = 0, rounds: int = KMEANS_ROUNDS, swaps: bool = False) -> DataFrame:
    """node, label.  With ``centres``, Lloyd rounds from them; else the run of least inertia of three from k-means++.

    K-means++ takes a pass for each centre; beyond ``PLUS_PLUS`` centres Spark's
    k-means|| draws them in a few passes.  With ``swaps``, centres of the best run
    from k-means++ are swapped as long as that lowers the inertia.  The points are
    written once, so that passes do not make them again.
    """
    points = materialise(points.select("node", "emb"), "kmeans-points")
    if centres is not None:
        return _lloyd(points, centres, rounds)[0].select("node", "label")
    if k <= PLUS_PLUS:
        runs = [_lloyd(points, book, rounds) for book in first_centres(points, k, seed) if book]
        if not runs:
            return points.select("node", F.lit(0).cast("long").alias("label"))
        best = min(runs, key=lambda run: run[2])
        return (_swapped(points, best, seed, rounds) if swaps else best)[0].select("node", "label")
    data = points.withColumn("features", array_to_vector("emb"))
    models = [KMeans(k=k, seed=seed + r, maxIter=rounds).fit(data) for r in range(KMEANS_RUNS)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    return best.transform(data).select("node", F.col("prediction").cast("long").alias("label"))


def ward_labels(points: np.ndarray, k: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Labels 0..k-1 of Ward linkage by nearest-neighbour chains, numbered by first member.

    Memory is that of the matrix of distances, n x n.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    merges = merges_of(points, np.ones(n) if weights is None else np.asarray(weights, float))
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for _, a, b in sorted(merges, key=lambda m: m[0])[: max(0, n - max(1, k))]:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    roots = [root(x) for x in range(n)]
    number = {r: i for i, r in enumerate(dict.fromkeys(roots))}
    return np.array([number[r] for r in roots], np.int64)


def ward(points: DataFrame, k: int, block: int = hierarchy.BLOCK, most: int = hierarchy.MOST) -> DataFrame:
    """node, label by agglomerative clustering with Ward linkage, exact for any number of points.

    Up to ``most`` clusters are merged by one task, more in rounds (see
    :mod:`wordloom.operators.hierarchy`).  Labels count from 0 by first member.
    """
    numbered = materialise(node_ids(points.select("node", "emb"), "node").withColumnRenamed("node_id", "id"), "ward-points")
    found = hierarchy.ward_cut(numbered.select("id", "emb"), k, block, most)
    named = node_ids(found.select("label").distinct(), "label").select("label", F.col("node_id").alias("cluster"))
    return numbered.select("node", "id").join(found, "id").join(named, "label").select("node", F.col("cluster").alias("label"))


def birch_leaves(points: DataFrame, threshold: float = BIRCH_THRESHOLD, leaves: int = BIRCH_LEAVES, branching: int = BRANCHING) -> DataFrame:
    """n, sums, squares of the sub-clusters of ``points`` (node, emb): one tree a partition, then trees of eight tasks' sub-clusters.

    A task keeps at most twice ``leaves`` sub-clusters, widening the threshold as
    needed; rounds go on until one table of at most ``leaves`` is left.
    """
    fields = "n double, sums array<double>, squares double"

    def gather(rows: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = Tree(threshold, branching)
            for b in batches:
                if b.num_rows:
                    own.add(*rows(b))
                if own.leaves > 2 * leaves:
                    own = own.shrunk(leaves)
            yield own.shrunk(leaves).table()

        return run

    def of_points(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = np.array(b.column("emb").to_pylist(), float)
        return np.ones(len(x)), x, (x**2).sum(axis=1)

    def of_features(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return b.column("n").to_numpy(), np.array(b.column("sums").to_pylist(), float), b.column("squares").to_numpy()

    found = materialise(points.orderBy("node").select("emb").mapInArrow(gather(of_points), fields).withColumn("part", F.spark_partition_id()), "birch")
    parts = (found.agg(F.max("part")).first()[0] or 0) + 1
    while parts > 1:
        parts = -(-parts // 8)
        grouped = found.where("n > 0").repartition(parts, F.floor(F.col("part") / 8)).sortWithinPartitions("part", "n", "squares").drop("part")
        found = materialise(grouped.mapInArrow(gather(of_features), fields).withColumn("part", F.spark_partition_id()), "birch")
    return found.where("n > 0").select("n", "sums", "squares")


def birch(points: DataFrame, k: int, threshold: float = BIRCH_THRESHOLD, leaves: int = BIRCH_LEAVES) -> DataFrame:
    """node, label: Ward linkage of the centres of :func:`birch_leaves`; a point gets the label of its nearest sub-cluster."""
    found = birch_leaves(points, threshold, leaves)
    rows = found.orderBy(F.desc("n"), "squares").collect()  # ``leaves`` rows at most
    if not rows:
        return points.select("node", F.lit(0).cast("long").alias("label"))
    centres = np.array([np.array(r["sums"]) / r["n"] for r in rows])
    labels = ward_labels(centres, k, np.array([r["n"] for r in rows]))
    near = nearest_centre(points, centres)
    names = F.array(*[F.lit(int(x)) for x in labels])
    return near.select("node", F.get(names, F.col("near")).cast("long").alias("label"))


def nearest_centre(points: DataFrame, centres: np.ndarray) -> DataFrame:
    """node, near: the nearest of the centres, by blocks of matrix products."""
    squares = (centres**2).sum(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.array(b.column("emb").to_pylist())
                yield pa.RecordBatch.from_arrays([b.column("node"), pa.array((squares[None, :] - 2 * x @ centres.T).argmin(axis=1).astype(np.int32))], names=["node", "near"])

    return points.select("node", "emb").mapInArrow(run, "node string, near int")
