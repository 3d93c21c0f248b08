"""Standardise, project, pool: from frames of words to embeddings."""

from __future__ import annotations

import math

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.functions.vectors import unit


def frame_statistics(frames: DataFrame) -> tuple[list[float], list[float]]:
    """Mean and population deviation of each dimension over all frames; a deviation of 0 counts as 1.

    Two numbers a dimension come back, whatever the number of frames.
    """
    v = array_to_vector("vec")
    row = frames.agg(Summarizer.metrics("mean", "variance", "count").summary(v).alias("s")).select("s.mean", "s.variance", "s.count").first()
    n = row["count"]
    if not n:
        return [], []
    deviation = [math.sqrt(x * (n - 1) / n) if n > 1 else 0.0 for x in row["variance"]]
    return list(row["mean"]), [d if d > 0 else 1.0 for d in deviation]


def standardise(frames: DataFrame) -> DataFrame:
    """``frames`` with vec at mean 0 and variance 1 over all frames of all words."""
    mean, deviation = frame_statistics(frames)
    stats = F.arrays_zip(F.array(*map(F.lit, mean)).alias("m"), F.array(*map(F.lit, deviation)).alias("d")) if mean else F.array()
    return frames.withColumn("vec", F.zip_with("vec", stats, lambda x, s: (x - s["m"]) / s["d"])) if mean else frames


def project(frames: DataFrame, components: int = 350, no_pca: bool = False) -> DataFrame:
    """Standardised frames on their first principal components, at most as many as dimensions."""
    scaled = standardise(frames)
    first = scaled.select(F.size("vec").alias("d")).first()
    if no_pca or first is None:
        return scaled
    vectors = scaled.withColumn("v", array_to_vector("vec"))
    model = PCA(k=min(components, first["d"]), inputCol="v", outputCol="p").fit(vectors)
    return model.transform(vectors).withColumn("vec", vector_to_array("p")).drop("v", "p")


def pool(frames: DataFrame, by: str = "node", normalise: bool = True) -> DataFrame:
    """by, emb: the mean of a word's frames, as a unit vector; words without frames have no row."""
    mean = vector_to_array(Summarizer.mean(array_to_vector("vec"))).alias("emb")
    pooled = frames.groupBy(by).agg(mean)
    return pooled.withColumn("emb", unit(F.col("emb"))) if normalise else pooled


def type_centroids(pooled: DataFrame, types: DataFrame, column: str = "text") -> DataFrame:
    """column, centroid: the mean of the (not normalised) vectors of a type's words that have one."""
    joined = pooled.join(types.select("node", column), "node").where(F.col(column).isNotNull())
    return joined.groupBy(column).agg(vector_to_array(Summarizer.mean(array_to_vector("emb"))).alias("centroid"))


def _uniform(*parts: Column) -> Column:
    """In (0, 1], from 52 bits of the md5 digest of the parts."""
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 1) / float(1 << 52)


def noisy_type_means(nodes: DataFrame, centroids: DataFrame, column: str = "text", seed: int = 42) -> DataFrame:
    """node, emb: the mean of a node's type plus Gaussian noise of a deviation drawn from 0.005..0.015.

    All draws come from hashes of node and dimension: a lost task repeats them.
    """
    sigma = 0.005 + 0.01 * _uniform(F.lit(seed), F.col("node"), F.lit("sigma"))
    typed = nodes.join(centroids, column).withColumn("sigma", sigma)

    def noise(i: Column) -> Column:
        radius = F.sqrt(-2 * F.log(_uniform(F.lit(seed), F.col("node"), F.lit("radius"), i)))
        return radius * F.cos(2 * math.pi * _uniform(F.lit(seed), F.col("node"), F.lit("angle"), i))

    return typed.select("node", F.transform("centroid", lambda x, i: x + F.col("sigma") * noise(i)).alias("emb"))
