"""Quantisation of frames to a codebook by a shortest path."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.operators import clustering


#: The split whose frames train the codebook of a language.
TRAIN_SPLIT = {"english": "train", "mandarin": "dev"}


def train_split(language: str) -> str:
    if language not in TRAIN_SPLIT:
        raise ValueError(f"no codebook split for language {language!r}")
    return TRAIN_SPLIT[language]


def train_codebook(frames: DataFrame, k: int, seed: int = 42, rounds: int = 100) -> DataFrame:
    """code, vec: k-means centres of all frames."""
    model = KMeans(k=k, seed=seed, maxIter=rounds, featuresCol="v").fit(frames.select(array_to_vector("vec").alias("v")))
    return _book(frames, [[float(x) for x in c] for c in model.clusterCenters()])


def train_codebook_by_batches(frames: DataFrame, k: int, batch_files: int = 10_000, seed: int = 42) -> DataFrame:
    """code, vec: mini-batch k-means over batches of ``batch_files`` files of frames (node, frame, vec), in order of a hash.

    It starts from k frames of the first batch, those whose hash is least; then
    each batch moves a centre to the mean of all frames that it has had so far.
    What comes back from a batch is k sums at most.
    """
    files = frames.select("node").distinct().count()
    batches = -(-files // batch_files) or 1
    dealt = frames.withColumn("batch", F.pmod(F.xxhash64(F.lit(seed), "node"), F.lit(batches)))
    drawn = dealt.where("batch = 0").orderBy(F.xxhash64(F.lit(seed), "node", "frame"), "node", "frame").limit(k)
    centres = np.array([r["vec"] for r in drawn.select("vec").collect()], float)
    counts = np.zeros(len(centres))
    for number in range(batches if len(centres) else 0):
        own = clustering.assign(dealt.where(F.col("batch") == number).select(F.col("vec").alias("emb")), centres.tolist())
        sums = own.groupBy("label").agg(F.count(F.lit(1)).alias("n"), vector_to_array(Summarizer.sum(array_to_vector("emb"))).alias("sum")).collect()
        for r in sums:
            at, n = r["label"], r["n"]
            centres[at] = (centres[at] * counts[at] + np.array(r["sum"])) / (counts[at] + n)
            counts[at] += n
    return _book(frames, centres.tolist())


def _book(frames: DataFrame, centres: list[list[float]]) -> DataFrame:
    return frames.sparkSession.createDataFrame(list(enumerate(centres)), "code int, vec array<double>")


def codebook_rows(codebook: DataFrame) -> list[tuple[int, list[float]]]:
    """The codebook by code: k rows, a parameter and not a function of the corpus."""
    return [(r["code"], r["vec"]) for r in codebook.orderBy("code").collect()]


def nearest_codes(frames: DataFrame, codebook: DataFrame, n: int | None = None) -> DataFrame:
    """``frames`` with codes array<struct<d, code>>: the n nearest codes (all if None), nearest first, ties to the lesser code.

    The codebook goes to the workers as one matrix; products of blocks choose, exact differences decide.
    """
    rows = codebook_rows(codebook)
    codes, book = np.array([c for c, _ in rows]), np.array([v for _, v in rows], float)
    kind = pa.list_(pa.struct([("d", pa.float64()), ("code", pa.int32())]))
    schema = T.StructType([*frames.schema.fields, *T.StructType.fromDDL("codes array<struct<d:double,code:int>>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: list[list[dict]] = []
            x = np.array(b.column("vec").to_pylist(), float).reshape(b.num_rows, -1)
            for first in range(0, b.num_rows, clustering.ROWS):
                far = clustering.distances(x[first : first + clustering.ROWS], book)
                for k, near in enumerate(clustering.candidates(far, n or len(book)), first):
                    d = ((book[near] - x[k]) ** 2).sum(axis=1)
                    order = np.lexsort((codes[near], d))[:n]
                    found.append([{"d": y, "code": c} for y, c in zip(d[order].tolist(), codes[near][order].tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, kind)], names=[*b.schema.names, "codes"])

    return frames.mapInArrow(run, schema)


def kept_codes(frames: np.ndarray, book: np.ndarray, codes: np.ndarray, neighbours: int | None) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each frame the places of its ``neighbours`` nearest codes, rising, and their squared distances.

    Products of blocks choose, exact differences decide; no more than a block of
    frames x codes, or a frame's codes x dimensions, is held.
    """
    keep, found = min(neighbours or len(book), len(book)), []
    for first in range(0, len(frames), clustering.ROWS):
        block = frames[first : first + clustering.ROWS]
        for x, near in zip(block, clustering.candidates(clustering.distances(block, book), keep), strict=True):
            d = ((x - book[near]) ** 2).sum(axis=1)
            chosen = np.sort(np.lexsort((codes[near], d))[:keep])
            found.append((near[chosen], d[chosen]))
    return found


def viterbi(frames: np.ndarray, book: np.ndarray, codes: np.ndarray, lmbda: float, neighbours: int | None) -> list[int]:
    """The code sequence of least  sum of squared distances - lmbda * number of repeats.

    Each frame may take one of its ``neighbours`` nearest codes; lmbda >= 0.  Only
    the kept codes of a frame and of the one before it meet.
    """
    kept = kept_codes(frames, book, codes, neighbours)
    (places, cost), back = kept[0], []
    for now, d in kept[1:]:
        best = int(cost.argmin())
        at = np.minimum(np.searchsorted(places, now), len(places) - 1)
        repeat = np.where(places[at] == now, cost[at] - lmbda, np.inf)
        stay = repeat <= cost[best]  # a repeat, or the best way from another code
        back.append(np.where(stay, at, best))
        places, cost = now, np.where(stay, repeat, cost[best]) + d
    path = [int(cost.argmin())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return [int(codes[p[i]]) for (p, _), i in zip(kept, reversed(path), strict=True)]


def quantise(words: DataFrame, codebook: DataFrame, lmbda: float, neighbours: int | None = None, deduplicate: bool = False) -> DataFrame:
    """node, units: the shortest path for each word (node, frames); words without frames have none.

    The codebook, k rows, goes to the workers with the function.
    """
    rows = codebook_rows(codebook)
    codes, book = np.array([c for c, _ in rows]), np.array([v for _, v in rows], float)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            units = [viterbi(np.array([list(f) for f in frames], float), book, codes, lmbda, neighbours) for frames in batch["frames"]]
            yield pd.DataFrame({"node": batch["node"], "units": units})

    found = words.where(F.size("frames") > 0).select("node", "frames").mapInPandas(run, "node string, units array<int>")
    return found.withColumn("units", without_repeats(F.col("units"))) if deduplicate else found


def without_repeats(units: Column) -> Column:
    """Drops each unit that equals the one before."""
    before = F.concat(F.array(F.lit(None).cast("int")), F.slice(units, 1, F.greatest(F.size(units) - 1, F.lit(0))))
    kept = F.filter(F.zip_with(units, before, lambda u, b: F.struct(u.alias("u"), b.eqNullSafe(u).alias("same"))), lambda x: ~x["same"])
    return F.transform(kept, lambda x: x["u"])
