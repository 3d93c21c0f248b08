"""Whole flows: from frames to a scored partition, and the idealised ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom import fixtures as fx
from wordloom.functions.vectors import unit
from wordloom.operators import clustering, communities, evaluate, features, lookup, pairwise
from wordloom.sources.catalog import Catalog, RunKey, materialise


def label_scores(labels: DataFrame) -> DataFrame:
    """One row of contingency scores of (true, pred)."""
    out = evaluate.purity(labels).withColumn("k", F.lit(1))
    for t in (evaluate.majority_completeness(labels), evaluate.v_measure(labels), evaluate.cluster_counts(labels)):
        out = out.join(t.withColumn("k", F.lit(1)), "k")
    return out.drop("k")


def flagship(spark: SparkSession, sf_dir: str, threshold: float = 0.7) -> DataFrame:
    """Frames to words, pooled; cosine graph; its components, scored against the labels."""
    frames = fx.word_frames(fx.frames(spark, sf_dir))
    emb = lookup.node_ids(features.pool(features.standardise(frames.select("node", "vec"))))
    edges = pairwise.cosine_graph(emb.select("node_id", "emb"), threshold)
    parts = communities.components(emb, edges)
    labels = parts.join(emb.select("node_id", F.split("node", "_")[0].alias("true")), "node_id").withColumnRenamed("component", "pred")
    return label_scores(labels)


def graph_clusters(nodes: DataFrame, edges: DataFrame, target: int, resolution: float = communities.RESOLUTION, start: DataFrame | None = None, catalog: Catalog | None = None, key: RunKey | None = None) -> DataFrame:
    """node_id, label by the constant Potts model; kept in (or taken from) the catalog under its key."""

    def make() -> DataFrame:
        return communities.cpm_partition(nodes, edges, target, resolution, start)

    return make() if catalog is None or key is None else catalog.get_or_make(key, make)


def centroid_clusters(emb: DataFrame, kind: str, k: int) -> DataFrame:
    """node, label by kmeans, birch or agg."""
    makers = {"kmeans": clustering.kmeans, "birch": clustering.birch, "agg": clustering.ward}
    if kind not in makers:
        raise ValueError(f"unknown partition type {kind!r}")
    return makers[kind](emb, k)


def with_types(nodes: DataFrame, words: DataFrame, phone_level: bool = False) -> DataFrame:
    """``nodes`` (filename, word_id) with text, the type of their word: its text, or its phones joined."""
    kind = F.array_join("phones", "-") if phone_level else F.col("text")
    return nodes.drop("text").join(words.select("filename", "word_id", kind.alias("text")), ["filename", "word_id"])


def unit_communities(units: DataFrame, threshold: float, target: int, resolution: float, start: DataFrame | None = None) -> DataFrame:
    """node_id, label: communities of the edit graph of (node_id, units), in which equal sequences are one node.

    Equal sequences have the same neighbours and an edge of weight 1, so below a
    resolution of 1 the objective never gains by parting them: the graph of distinct
    sequences, with their counts and the summed weights, has the same optima and no
    edge for each pair of copies.  A sequence starts in the community that most of
    its nodes start in.  Above 1 every node stands alone; that is taken if the
    number asked for is nearest to it.
    """
    kinds = units.groupBy("units").agg(F.min("node_id").alias("head"), F.count(F.lit(1)).alias("size"))
    kinds = materialise(kinds.withColumnRenamed("head", "node_id"), "unit-kinds")
    size = lambda end: kinds.select(F.col("node_id").alias(end), F.col("size").alias(f"size_{end}"))
    edges = pairwise.edit_graph(kinds.select("node_id", "units"), threshold).join(size("i"), "i").join(size("j"), "j")
    edges = materialise(edges.select("i", "j", (F.col("w") * F.col("size_i") * F.col("size_j")).alias("w")), "unit-edges")
    heads = materialise(units.join(kinds.select("units", F.col("node_id").alias("head")), "units").select("node_id", "head"), "unit-heads")
    if start is not None:
        counted = heads.join(start, "node_id").groupBy("head", "label").agg(F.count(F.lit(1)).alias("n"))
        start = counted.groupBy(F.col("head").alias("node_id")).agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("label"))
    found = communities.cpm_partition(kinds.select("node_id", "size"), edges, target, resolution, start)
    made, n = found.select("label").distinct().count(), heads.count()
    if abs(made - target) > max(communities.TOLERANCE, abs(n - target)):
        return heads.select("node_id", F.col("node_id").alias("label"))
    return heads.join(found.withColumnRenamed("node_id", "head"), "head").select("node_id", "label")


def graph_from_types(units: DataFrame, threshold: float, resolution: float = 0.3144) -> DataFrame:
    """node_id, label: edit graph of (node, text, units), communities started from the true types."""
    placed = materialise(lookup.node_ids(units), "unit-nodes")
    codes = lookup.first_appearance_codes(placed, "text", "node_id")
    start = placed.join(codes, "text").select("node_id", F.col("code").alias("label"))
    return unit_communities(placed, threshold, codes.count(), resolution, start)


def graph_of_replicas(units: DataFrame, threshold: float, resolution: float = communities.RESOLUTION) -> DataFrame:
    """node_id, label: edit graph of one drawn unit sequence a type of (node, text, units), and its communities."""
    placed = materialise(lookup.node_ids(lookup.replicate_sample(units)), "unit-nodes")
    return unit_communities(placed, threshold, lookup.type_count(placed).first()[0], resolution)


def pooled_by_word(frames: DataFrame, components: int | None = None) -> DataFrame:
    """node, emb: the mean of a word's standardised (and projected) frames, not normalised."""
    made = features.standardise(frames) if components is None else features.project(frames, components)
    return features.pool(made, normalise=False)


def kmeans_from_types(pooled: DataFrame, types: DataFrame) -> DataFrame:
    """node, label: k-means of unit vectors from the types' means (node, text), which are not normalised."""
    centroids = features.type_centroids(pooled, types)
    centres = [r["centroid"] for r in centroids.orderBy("text").collect()]  # one row a type: the number of clusters asked for
    return clustering.kmeans(pooled.withColumn("emb", unit(F.col("emb"))), len(centres), centres)


def kmeans_of_noise(pooled: DataFrame, types: DataFrame) -> DataFrame:
    """node, label: k-means of the types' means with noise."""
    noisy = features.noisy_type_means(types, features.type_centroids(pooled, types))
    return clustering.kmeans(noisy, lookup.type_count(types).first()[0], swaps=True)
